import random

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu") for b in ("le", "mo", "sa", "vi", "") for c in ("n", "r", "st", "")]


def prose(seed, n):
    draw = random.Random(seed)
    words = [draw.choice(WORDS) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."
