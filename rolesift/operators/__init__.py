"""Set-oriented steps, each DataFrame -> DataFrame."""
