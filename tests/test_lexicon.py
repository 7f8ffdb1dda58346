"""Clauses, topics, suggestions, absences and outcomes on example sentences."""

import pytest

from plumbline.operators import lexicon as L

M = L.matcher(L.LEXICON)


def topics(clause):
    return [t for t in L.TOPICS if t in {w.topic for w in M.topics(clause)}]


def clauses(text):
    t = L.normalized(text)
    return [t[a:b] for a, b in M.clauses(t)]


def test_clauses():
    assert clauses("Quite a spectacular hotel from the outside.Room was clean and tidy ;-)Hotel staff were always helpfulMost impressive is the location. Hudson Cafeteria... closed. Horrible.") == ["Quite a spectacular hotel from the outside.", "Room was clean and tidy ;-)", "Hotel staff were always helpful", "Most impressive is the location.", "Hudson Cafeteria... closed. Horrible."]
    assert clauses("Tom &amp; Jerry loved the pool.") == ["Tom & Jerry loved the pool."]
    assert clauses("Parking is 7 min walk also fine\nThe biggest issue was the check-in") == ["Parking is 7 min walk also fine", "The biggest issue was the check-in"]
    assert clauses("Airconds provided but all not cold.") == ["Airconds provided but all not cold."]
    assert clauses("The staff were lovely, but the breakfast was cold.") == ["The staff were lovely", "the breakfast was cold."]
    assert clauses("The room near St. Pancras was fine.") == ["The room near St. Pancras was fine."] and clauses("") == []


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        ("However, after requesting a late check-out we found ourselves locked out of our room.", ["staff.checkin"]),
        ("I got the room at 3rd floor without lift with baggages.", ["facilities.access"]),
        ("there was not a single place to put your cloths, neither in the rooms nor in the bathroom.", ["room.storage"]),
        ("The location was fabulous, with central park and loads of restaurants.", ["location.general"]),
        ("i had a chance to check out the spa which i loved", ["facilities.leisure"]),
        ("Staineless steel washing hand basin in bathroom is a bit tacky", ["room.bathroom"]),
        ("Since it’s located in an old building, there’s a strong and unpleasant odor as soon as you open the door", ["cleanliness.odour"]),
        ("Airconds should be well service before you sell your rooms.", ["room.climate"]),
        ("The apartment itself was clean, quiet, comfortable, and very welcoming.", ["cleanliness.general", "room.comfort", "noise.general"]),
        ("Very helpful host with all of the instructions and recommendations.", ["staff.people"]),
        ("the sounds of walking or moving furniture were extremely loud", ["noise.general"]),
        ("the noise from the bars below was really bad", ["noise.general"]),
        ("For me this is just very poor and cheap, normal you send your passport", ["staff.checkin"]),
        ("The bed was too small, we had a baby, there was no cod", ["room.bed", "facilities.family"]),
        ("140cm bed meaning even without a baby it’s actually small for two adults", ["room.bed"]),
        ("Great for families with small kids.", ["facilities.family"]),
        ("the shower area was very small.", ["room.bathroom"]),
        ("Below you see the hair in my towel", ["cleanliness.linen"]),
        ("The room was very clean, not much of a view.", ["cleanliness.general", "room.view"]),
        ("the self check-in process was straightforward, although we never met the host in person.", ["staff.checkin"]),
        ("Parking was expensive.", ["value.charges", "facilities.parking"]),
        ("A small pool and a tiny breakfast room", ["food.breakfast", "facilities.leisure"]),
        ("The room was spotless", ["cleanliness.general"]),
        ("nothing at all to say", []),
    ],
)
def test_topics(clause, expected):
    assert topics(clause) == expected


def found(spark, *texts, load=lambda: lambda pairs: [("positive", 0.95)] * len(pairs)):
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id int, text string")
    return L.analysed(rows, "review_id", "text", load)


def sides(rows):
    return {(r["topic"], r["sentiment"]) for r in rows}


def test_rules_decide_before_the_model(spark):
    cases = {
        "Airconds provided but all not cold.": {("room.climate", "negative")}, "The shower was lukewarm at best.": {("room.bathroom", "negative")},
        "the host is saving on hangers.": {("staff.people", "negative"), ("room.storage", "negative")}, "I woke up with bed bug bites.": {("cleanliness.pests", "negative")},
        "No bed bugs, no stains.": {("cleanliness.pests", "positive"), ("cleanliness.general", "positive")}, "There was no kettle and no hangers.": {("room.equipment", "negative"), ("room.storage", "negative")},
        "No problems at all with the wifi.": {("facilities.wifi", "positive")}, "Below you see the hair in my towel": {("cleanliness.linen", "negative")}, "Spotless towels, not a hair in sight.": {("cleanliness.linen", "positive")},
        "You should definitely stay here, the location is great.": {("location.general", "positive")}, "": set(), "Put some hangers to people can out the wet towels or cloths": {("room.storage", "negative"), ("cleanliness.linen", "positive")},
        "The AC didn't work, so we asked for a fan.": {("room.climate", "positive")}, "Whenever I had an issue, he responded quickly and took care of it.": {("staff.response", "positive"), ("staff.resolution", "positive")},
    }
    got = found(spark, *cases).collect()
    for i, (text, want) in enumerate(cases.items()):
        assert sides(r for r in got if r["review_id"] == i) == want, text
    hanger = next(r for r in got if r["topic"] == "room.storage" and r["quote"].startswith("Put"))
    assert (hanger["flags"], hanger["confidence"]) == (["suggestion"], 1.0)


def test_outcomes_are_mentions_with_their_report():
    text = "Even after I reported the issue, and Francesco kindly came with tools to clean, it didn’t make any real difference."
    told = lambda t: L.outcomes(t, M.sentences([t])[0])
    [(a, b, sentiment, _)] = told(text)
    assert text[a:b] == text and sentiment == "negative"
    two = "We called the reception. Nobody came."
    assert [(two[a:b], s) for a, b, s, _ in told(two)] == [(two, "negative")] and told("The AC didn't work, so we asked for a fan.") == []


def test_unsure_answers_typos_and_grouping(spark):
    got = found(spark, "The breakfast was fine.", load=lambda: lambda pairs: [("negative", 0.55)] * len(pairs)).first()
    assert got["flags"] == ["check"] and got["confidence"] == 0.55
    [cot] = [r for r in found(spark, "We had a baby and there was no cod.").collect() if r["sentiment"] == "negative"]
    assert (cot["topic"], cot["word"], cot["flags"]) == ("facilities.family", "cod", ["check", "typo"])
    beds = found(spark, "The bed was too small. The bed was small for two adults. Great location.", load=lambda: lambda pairs: [("negative" if "small" in c else "positive", 0.9) for c, _ in pairs])
    [bed] = [r for r in L.group_mentions(beds).collect() if r["topic"] == "room.bed"]
    assert bed["quotes"] == ["The bed was too small.", "The bed was small for two adults."] and bed["sentiment"] == "negative"
    assert found(spark, "The staff were there.", load=lambda: lambda pairs: [(None, 0.9)] * len(pairs)).count() == 0


def test_the_scorer_is_asked_through_things_in_order_of_length(spark):
    jobs, _ = L.asked(spark.createDataFrame([(1, "Small fridge in room was nice."), (2, "The apartment was comfortable.")], "review_id int, text string"), "review_id", "text")
    assert [r["word"] for r in jobs.orderBy("review_id", "topic").collect()] == ["fridge", "comfortable", "apartment"] or sorted(r["word"] for r in jobs.collect()) == ["apartment", "comfortable", "fridge"]
    own = L.scored(jobs, lambda: lambda pairs: [(w, float(len(c))) for c, w in pairs]).collect()
    assert all(r["label"] == r["word"] and r["p"] == len(r["clause"]) for r in own)


def test_tags_and_defined_cases(spark):
    rows = spark.createDataFrame([(1, "The bed was hard. The bed creaked."), (2, None), (3, ""), (4, "xyzzy")], "review_id int, negative string")
    assert [tuple(r) for r in L.tag_complaints(rows).collect()] == [(1, "room.bed", "The bed was hard.")]
    assert L.tag_complaints(rows.where("false")).count() == 0


def test_the_search_over_sentences_spares_none_with_a_topic():
    import itertools
    import random

    rng = random.Random(3)
    parts = ["room", "beds", "hair dryer", "hot water", "$ 20", "20 €", "cafés", "a/c", "stained", "stainless", "in person", "tools to clean", "safe", "the safe area", "kind", "é", "-", "’s", "bit", "m2", "cods", "x"]
    for _ in range(3000):
        t = "".join(itertools.chain.from_iterable((rng.choice(parts), rng.choice([" ", "", "-", ", ", "é"])) for _ in range(rng.randint(1, 6)))).strip()
        [own] = M.sentences([t])
        for a, b, some, _ in own:
            assert some or not M.words(t[a:b]), t
    assert L.plain(r"a(?!b(?:c\)|d))e(?<=x)f") == "aef"
