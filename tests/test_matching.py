import json

from pyspark.sql import functions as F

from rolesift.operators.matching import match_postings, match_with_source_profiles
from rolesift.operators.rules import profile_of, source_profiles

# bakery jobs under rules of their own: (id, title, place, text)
RULES = profile_of(
    positive={"bread": {"weight": 0.8, "terms": ["bread baker", "sourdough"]}, "pastry_chef": 0.6, "oven": {"weight": 0.3, "terms": ["oven"]}},
    negative={"night": {"weight": 0.25, "terms": ["night shift"]}, "trainee": 0.5},
    places=["ghent", "porto"], remote=["from anywhere"], regions=["iberia"],
)
POSTINGS = [
    ("k", "Bread Baker", "Ghent", "Runs the oven, bakes sourdough"),
    ("l", "Pastry chef", "Lyon", "Cakes"),
    ("m", "Trainee, bread baker", "Porto", "Some night shift"),
    ("n", "Pastry Chef and Bread Baker", "From anywhere", "anyone in Iberia"),
    ("o", "Waiter", "Porto", "Carries bread"),
    ("p", "Sourdough lead", "from anywhere", "worldwide"),
]
SCHEMA = "source_id string, title string, location string, description string"


def by_source(rows):
    return {r["source_id"]: r for r in rows.collect()}


def test_scores_by_hand(spark):
    got = by_source(match_postings(spark.createDataFrame(POSTINGS, SCHEMA), RULES, 0.4, enable_remote=True))
    want = {
        "k": (0.65 * 0.8 + 0.35 * 1.0, "send"),  # text: 0.8 + 0.3, no more than 1
        "l": (0.65 * 0.6, "reject_geo"),
        "m": (0.0, "reject_score"),  # 0.52 - 0.5 - 0.25, no less than 0
        "n": (0.65 * 1.0, "send"),  # 0.6 + 0.8, no more than 1; anywhere in Iberia
        "o": (0.0, "reject_score"),
        "p": (0.65 * 0.8, "reject_geo"),
    }
    assert {k: (round(r["score"], 9), r["decision"]) for k, r in got.items()} == {k: (round(s, 9), d) for k, (s, d) in want.items()}
    assert got["k"]["matched_terms"] == ["bread baker", "oven", "sourdough"]
    closed = by_source(match_postings(spark.createDataFrame(POSTINGS, SCHEMA), RULES, 0.4))
    assert closed["n"]["decision"] == "reject_geo" and closed["k"]["decision"] == "send"


def test_settings():
    profile = profile_of(positive={"head_baker": 2, "Y ": {"weight": 0.5, "terms": [" Rye", "rye", ""]}, "none": {"terms": ["x"]}, "as_text": {"weight": " 0.9", "terms": ["z"]}, "odd": {"weight": "much", "terms": ["o"]}, "text": "y", "": 1, "minus": -1})
    assert [(r.family, r.weight, r.terms) for r in profile.positive] == [("head_baker", 2.0, ("head baker",)), ("y", 0.5, ("rye",)), ("as_text", 0.9, ("z",))]
    assert len(profile_of(positive={}, places=[]).positive) == 12
    assert profile_of(places=[" Faro ", "faro", ""]).places == ("faro",)


def test_overrides_of_sources(spark):
    override = {
        "positive_terms": {"bread": {"weight": 0}, "waiter": {"weight": 0.9, "terms": ["Waiter "]}, "oven": {"terms": ["kiln"]}, "z": 0.2, "b": 0.1, "no": {"terms": ["q"]}, 'so "x"?': {"weight": 0.0, "terms": ["u"]}},
        "geo_terms": ["Lyon"], "remote_terms": 5,
    }
    rows = [(p[0], json.dumps(override) if p[0] in "lo" else None) for p in POSTINGS]
    profiles = source_profiles(spark.createDataFrame(rows, "source_id string, matching_profile string"), RULES)
    own = by_source(profiles)["o"]
    assert [r["family"] for r in own["positive"]] == ["pastry_chef", "oven", "waiter", "z", "b"]
    assert own["positive"][1]["terms"] == ["kiln"] and own["places"] == ["ghent", "porto", "lyon"] and own["remote"] == ["from anywhere"]
    got = by_source(match_with_source_profiles(spark.createDataFrame(POSTINGS, SCHEMA), profiles, 0.35))
    assert (round(got["o"]["score"], 9), got["o"]["decision"], got["o"]["matched_terms"]) == (round(0.65 * 0.9 + 0.35 * 0.1, 9), "send", ["b", "waiter"])
    assert got["l"]["decision"] == "send"
    plain = by_source(match_postings(spark.createDataFrame(POSTINGS, SCHEMA), RULES, 0.35))
    assert all(got[k] == plain[k] for k in "kmnp")


def test_filter_on_the_decision_does_not_repeat_the_search(spark):
    sent = match_postings(spark.createDataFrame(POSTINGS, SCHEMA), RULES).filter(F.col("decision") == "send")
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    # once for the score, once for the matched terms
    assert plan.count("sourdough") <= 6
