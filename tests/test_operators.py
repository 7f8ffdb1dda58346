from datetime import datetime

import pytest

from pyspark.sql import functions as F

from plumbline.operators import aspects as AS
from plumbline.operators import dataset as D
from plumbline.operators import metrics as M
from plumbline.operators import state as ST
from plumbline.operators import triage as R


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_aspect_priorities(spark):
    s = "id long, review_id string, aspect string, sentiment string"
    now = rows(spark, [(1, "a", "cleanliness", "negative"), (2, "b", "cleanliness", "negative"), (3, "c", "cleanliness", "positive"), (4, "a", "staff", "positive"), (5, "b", "staff", "positive"), (6, "c", "staff", "mixed")], s)
    out = AS.summary(now, now.where("false")).collect()
    assert [(r["aspect"], r["negative_rate"], r["priority_score"], r["trend"]) for r in out] == [("cleanliness", 0.6667, 0.6, None), ("staff", 0.0, 0.2167, None)]
    before = rows(spark, [(i, str(i), "a", "negative" if i < 3 else "positive") for i in range(4)], s)
    later = rows(spark, [(1, "x", "a", "negative"), (2, "x", "a", "positive"), (3, "y", "a", "positive")], s)
    r = AS.summary(later, before).first()
    assert (r["review_count"], r["negative_rate"], r["trend"]) == (2, 0.5, -0.25)
    assert AS.summary(now.where("false"), now).count() == 0


def test_votes(spark):
    v = rows(spark, [("r", "staff", "positive"), ("r", "room", "positive"), ("r", "food", "negative"), ("t", "a", "positive"), ("t", "b", "negative")], "review_id string, aspect string, sentiment string")
    assert dict(AS.review_vote(v).collect()) == {"r": "positive", "t": None}


def test_windows_are_half_open(spark):
    t = rows(spark, [(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 8)), (2, datetime(2024, 1, 2))], "hotel_id int, review_ts timestamp")
    assert AS.in_window(t, 1, datetime(2024, 1, 8), 7).count() == 1


def test_metrics(spark):
    p = rows(spark, [(0, 0)] * 3 + [(0, 1), (1, 0), (1, 1)], "t int, p int")
    m = {r["label"]: r for r in M.class_metrics(p, "t", "p").collect()}
    assert (m[0]["precision"], m[0]["recall"], m[1]["f1"]) == (0.75, 0.75, 0.5)
    o = M.overall(M.class_metrics(p, "t", "p"), p, "t", "p").first()
    assert round(o["macro_f1"], 3) == 0.625 and round(o["accuracy"], 4) == 0.6667
    constant = rows(spark, [(1, 1)] * 3, "a int, b int")
    assert M.cohen_kappa(constant, "a", "b").first()["kappa"] is None
    grid = M.threshold_grid(rows(spark, [(0.9, 1), (0.4, 1), (0.6, 0)], "p double, t int"), "p", "t", [0.5, 0.3])
    assert {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in grid.collect()} == {0.3: (2, 1, 0), 0.5: (1, 1, 1)}
    f = M.frontier(rows(spark, [("a", 1.0, 0.9), ("b", 2.0, 0.8), ("c", 3.0, 0.95)], "m string, c double, g double"), "m", "c", "g")
    assert {r["m"] for r in f.collect()} == {"a", "c"}


def test_splits_and_samples(spark):
    r = rows(spark, [(i, i % 2, f"h{i // 20}") for i in range(200)], "id long, label int, hotel string")
    s = D.stratified_split(r, "id", "label", test=0.1, dev=0.1)
    assert {x["split"]: x["count"] for x in s.groupBy("split").count().collect()} == {"test": 20, "dev": 18, "train": 162}
    g = D.group_split(r, "hotel", test=0.2, dev=0.2)
    assert {x["split"]: x["count"] for x in g.groupBy("split").count().collect()} == {"test": 40, "dev": 40, "train": 120}
    assert not D.assert_disjoint(g, "hotel") and D.cap_per_class(r, "id", "label", 5).count() == 10
    w = D.stratified_sample(r, "id", "hotel", 4).select("weight").distinct().collect()
    assert [x["weight"] for x in w] == [5.0]
    assert sorted(x["rank"] for x in D.global_rank(r, D.hash_order("0", "id")).collect()) == list(range(1, 201))
    assert D.fingerprint(r, "id", "label") == D.fingerprint(r.repartition(7), "id", "label") != D.fingerprint(r.limit(199), "id", "label")


def test_labelled_corpus(spark):
    raw = rows(spark, [("Good Hotel", "No Negative"), ("good   hotel", "No Negative"), ("No Positive", "Bad Hotel"), ("both", "sides"), ("Fine", ""), ("", "fine"), ("Odd", "No Negative"), ("No Positive", "odd")], "Positive_Review string, Negative_Review string")
    assert sorted((r["text"], r["label"]) for r in D.extract_labelled(raw).collect()) == [("Bad Hotel", 0), ("Good Hotel", 1)]


def test_small_lexicon_and_routing(spark):
    t = rows(spark, [("The shower was really cold",), ("The shower was cold, they fixed it",), ("Nice",)], "text string")
    assert [r["bathroom"] for r in R.lexicon_v1(t).collect()] == ["yes", "unsure", "unsure"]
    a = rows(spark, [("I saw a broken lamp", '```[{"excerpt": "broken lamp", "problem": "lamp", "department": "rooms", "suggestion": "repair it"}, {"excerpt": "not there", "problem": "lamp", "department": "rooms", "suggestion": "repair it"}]```'), ("x", "no list")], "text string, answer string")
    assert [(r["n_parsed"], r["n_dropped"]) for r in R.actions(a, ("rooms",)).collect()] == [(2, 1), (0, 0)]


def test_state(spark):
    log = rows(spark, [("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "x", False), ("b", 2, None, True)], "k string, v int, p string, gone boolean")
    assert [(r["k"], r["p"]) for r in ST.latest(log, ["k"], "v", "gone").collect()] == [("a", "y")]
    m = rows(spark, [(1, 1, "assigned"), (1, 2, "resolved"), (1, 3, "in_progress")], "ticket_id int, at int, state string")
    assert tuple(ST.ticket_state(m).first()) == (1, "resolved", 1)
    o = rows(spark, [(1, 4), (2, 0)], "id int, attempts int").withColumns({"state": F.lit("pending"), "next_attempt_at": F.lit(datetime(2024, 1, 1))})
    assert [(r["state"], r["next_attempt_at"]) for r in ST.failed(o, datetime(2024, 1, 2), "x" * 400).orderBy("id").collect()] == [("failed", None), ("pending", datetime(2024, 1, 2, 0, 0, 30))]


def test_sources(spark, tmp_path):
    from plumbline.sources import files

    p = tmp_path / "a.csv"
    p.write_text("﻿id,text\n1,\"a \"\"b\"\", c\"\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in files.csv_strings(spark, str(p)).collect()] == [("1", 'a "b", c'), ("2", "")]
    t = rows(spark, [("one\n\n two  words \n",)], "value string")
    assert [r["text"] for r in files.paragraphs(t).collect()] == ["one", "two words"]
    r = rows(spark, [(1, "s", "x", "the room was fine and clean"), (1, "s", "x", "the bed was not very good")], "hotel_id int, source string, external_review_id string, text string")
    assert [x["reason"] for x in files.import_problems(r).collect()] == ["repeated"]


def test_ordinals_follow_the_source_order(spark):
    from plumbline.sources import files

    df = rows(spark, [(i * 7 % 501, i % 3) for i in range(501)] + [(None, 1)], "at int, k int").repartition(5)
    got = files.with_ordinal(df, "at", "k", buckets=8).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(502)) and [r["at"] for r in got] == [None, *sorted(i * 7 % 501 for i in range(501))]
    assert files.with_ordinal(df.where("false"), "at").count() == 0


def test_checks_refuse_whole(spark):
    from plumbline.operators import checks as C

    a = rows(spark, [(1, "x"), (2, "y")], "id int, v string")
    assert [tuple(r) for r in C.one_to_one(a, rows(spark, [(1, 5)], "id int, w int"), "id").orderBy("id").collect()] == [(1, "x", 5), (2, "y", None)]
    with pytest.raises(C.Refused, match="id repeats in the right table"):
        C.one_to_one(a, rows(spark, [(1, 5), (1, 6)], "id int, w int"), "id")
    with pytest.raises(C.Refused, match="nothing is used"):
        C.refuse(C.misaligned(a, a.where("id = 1"), "id", "v"), "pairs")
    C.refuse(C.misaligned(a, a, "id", "v"), "pairs")
    with pytest.raises(C.Refused, match="missing columns"):
        C.require_columns(a, "id", "text")
    assert C.manifest_problems({"a": "1", "b": "2"}, {"b": "3", "c": "4"}) == ["a: not recorded", "b: changed", "c: missing"]
    assert C.redrawn(a, a, ["id", "v"]).count() == 0 and C.redrawn(a, a.where("id = 1"), ["id", "v"]).first()["side"] == "drawn"
    assert C.same({"a": [1.0, True]}, {"a": [1.0 + 1e-12, True]}) == [] and C.same({"a": [1, True]}, {"a": [1, 1]}) == [".a[1]: True and 1"] and C.same({"a": 1}, {"b": 1}) == [".a: on one side", ".b: on one side"]
    assert C.verified({"n": 3}, {"n": lambda: 3.0, "m": lambda: 1}) == ["m: not recorded"]
    c = rows(spark, [(1, 1, [0.4, 0.6], "m"), (2, 2, [0.4, 0.5], "m"), (3, 4, [1.0, 0.0], "n")], "id int, place int, p array<double>, model string")
    i = rows(spark, [(1, 1), (2, 2), (3, 3)], "id int, place int")
    assert sorted(map(tuple, C.cache_problems(c, i, "id", "place", "p", "model").collect())) == [(2, "no distribution"), (3, "another model"), (3, "place differs")]


def test_generated_answers(spark):
    from plumbline.operators import generated as N

    assert N.first_object('x {"a": {"b": 1, "b": 2}}') == (None, "repeated_key") and N.first_object("{[") == (None, "none") and N.first_object(None) == (None, "none")
    assert N.diagnosis('{"a": 1} tail') == (False, []) and N.diagnosis(' {"a": {"b": 1, "b": 2}} ') == (False, ["b"]) and N.diagnosis("{}") == (True, [])
    assert N.source_spans("One two. x\nThree four; five six") == ["One two.", "x\nThree four;", "five six"] or all(3 <= len(s) <= 400 for s in N.source_spans("One two. x\nThree four; five six"))
    long = "word " * 300
    assert all(len(s) <= 400 for s in N.source_spans(long)) and "".join(N.source_spans(long)).replace(" ", "") == long.replace(" ", "")
    b = rows(spark, [('{"labels": [{"item": 1, "types": ["b", "a", "a"]}, {"item": 2, "types": []}]}', [1, 2]), ('```json\n{"labels": [{"item": 1, "types": ["zz"]}]}\n```', [1]), ('{"labels": [{"item": 1, "types": []}]}', [1, 2]), ("no", [1])], "a string, items array<int>")
    got = N.batch_answers(b, "a", "items", ("a", "b")).collect()
    assert [r["refused"] for r in got] == [None, "types", "items", "no_object"] and got[0]["labels"] == {1: ["a", "b"], 2: []}
    q = '{"issues": [{"problem": "lamp broke", "excerpt": "the lamp broke", "evidence": {"reported": "the lamp broke", "hypothetical": null, "resolved": null}, "status": "REAL_PENDING", "category": "equipment_fault"}]}'
    i = N.issues(rows(spark, [(q, "Oh, the lamp broke."), (q, "another text"), (q.replace("equipment_fault", "x"), "the lamp broke"), ("{}", "t")], "a string, t string"), "a", "t")
    assert [r["refused"] for r in i.collect()] == [None, "quotes", "fields", "no_object"]
    m = N.measures(i.where("refused is null").withColumn("m", F.lit('{"actions": [{"issue_id": 1, "measure": "replace it", "to_confirm": ["which lamp"]}]}')), "m").first()["actions"]
    assert [(a["department"], a["measure"]) for a in m] == [("maintenance", "replace it")]
    u = rows(spark, [(["b", "a", "z"], ["a", "b", "c"])], "t array<string>, c array<string>")
    assert u.select(N.urgent_flags(F.col("t"), F.col("c"), ["a", "b", "c"])).first()[0] == ["a", "b"]


def test_judgements(spark):
    import numpy as np

    from plumbline.operators import judging as J

    pairs = J.model_comparison(rows(spark, [("a", 1, 1), ("a", 2, 0), ("b", 1, 0), ("b", 2, 0), ("c", 1, 1)], "model string, id int, predicted int"), rows(spark, [(1, 1), (2, 0)], "id int, label int"), "id")
    assert [(r["model"], r["accuracy"]) for r in pairs[0].orderBy("model").collect()] == [("a", 1.0), ("b", 0.5)] and J.tested(pairs[1])[0]["p"] == 1.0
    t = np.array([[[5, 1], [1, 5]]] * 6)
    assert J.paired_cluster_bootstrap(t, t) == (0.0, 0.0, 0.0)
    k = J.kappa_interval(np.array([[40, 5], [5, 50]]))
    assert k["status"] == "ok" and k["low"] < k["kappa"] < k["high"] and J.kappa_interval(np.array([[9, 0], [0, 0]]))["status"] == "undefined"
    s = rows(spark, [(1, "x", 0.5, 0, 1.0), (2, "x", 0.9, 0, 1.0), (3, "x", 0.9, 1, 1.0), (4, "y", 0.2, 0, 1.0)], "review_id int, type string, p double, truth int, weight double")
    final, steps = J.risen(s, {"x": 0.4, "y": 0.4}, 25.0)
    assert steps[0]["fa"] == 50.0 and final == {"x": 0.55, "y": 0.55} and len(steps) == 4
    assert J.variant([("A", 0.5, 9.0), ("B", 0.7, 4.0), ("C", 0.7, 3.0)], 5.0) == "B" and J.variant([("A", 0.5, 9.0)], 5.0) == "A"
    lead = rows(spark, [("s", 0.80), ("h", 0.78)], "n string, v double")
    assert J.by_margin(lead, "n", "v", "s", 0.05).first()["best"] == "h" and J.by_margin(lead, "n", "v", "s", 0.01).first()["best"] == "s"
    h = rows(spark, [(True, 4, 5), (True, 3, 5), (False, 0, 5)], "qualifies boolean, a int, b int")
    assert tuple(map(float, J.macro(h, "a", "b"))) == (0.7, 0.6)
    line = J.context_line(rows(spark, [("noise", 3, 0.9), ("room", 0, 0.8), ("food", 2, 0.95)], "aspect string, negative_count int, priority_score double"), 30).first()["line"]
    assert line.endswith("(last 30 days): food 2, noise 3")
    sheet = rows(spark, [("a", 1, 1, 1, 0, 0, 1, 0, 0, 0, False), ("b", 0, 0, 0, 0, 0, 2, 1, 1, 0, False), ("c", 1, 1, 1, 1, 0, 1, 0, 0, 0, True)], "blind_id string, n_actions int, useful int, useful_actions int, wrong_department int, unnecessary int, actual int, missed int, unaddressed int, invented int, failed boolean")
    assert {(r[0], r[1]) for r in J.ratings_refused(sheet).collect()} == {("b", "nothing accepted, yet addressed"), ("c", "more judged than accepted"), ("c", "failed and useful"), ("c", "useful with shortcomings")}
    assert J.coverage(sheet).first()["addressed"] == 0.75


def test_small_rules(spark, tmp_path):
    import hashlib

    from plumbline.functions import stats as S
    from plumbline.operators import trends as T
    from plumbline.plans import catalog
    from plumbline.sources import files

    n = lambda x: F.lit(float(x))
    low, high = spark.range(1).select(*S.wilson(n(0), n(10))).first()
    assert low == 0.0 and 0 < high < 1 and spark.range(1).select(*S.wilson(n(0), n(0))).first()[0] is None
    with pytest.raises(Exception, match="success in each sample"):
        spark.range(1).select(*S.katz(n(0), n(9), n(3), n(9), strict=True)).collect()
    with pytest.raises(Exception, match="too few dates"):
        D.time_split(rows(spark, [("a", 1), ("b", 2)], "day string, id int"), "day", train=0.8, dev=0.1).collect()
    shared = rows(spark, [(1, "train"), (1, "test")], "k int, split string")
    with pytest.warns(UserWarning, match="splits share"):
        assert len(D.assert_disjoint(shared, "k", policy="warn")) == 1
    assert D.assert_disjoint(shared, "k", policy="ignore")
    t = rows(spark, [(1, "a", 0), (2, "b", 1)], "at int, text string, label int")
    want = hashlib.sha256(b"".join(len(x).to_bytes(8, "big") + x for x in (b"a", b"0", b"b", b"1"))).hexdigest()
    assert D.ordered_digest(t.repartition(2), "at", "text", "label") == want
    twice = rows(spark, [(1, "x"), (2, "x"), (3, "y")], "id int, k string")
    assert D.duplicates(twice, "k", "drop", "id").count() == 2 and D.duplicates(twice, "k", "keep", "id").select("group").distinct().count() == 3
    short = D.shortfalls(rows(spark, [("a",), ("a",)], "drawn_for string"), {"a": 2, "b": 1}).collect()
    assert [tuple(r) for r in short] == [("b", 1, 0)]
    with pytest.raises(ValueError, match="no decision"):
        R.settled(rows(spark, [(1, 0, 1)], "k int, a int, b int"), rows(spark, [], "k int, decision int"), ["k"])
    assert [tuple(r) for r in R.settled(rows(spark, [(1, 0, 1), (2, 1, 1)], "k int, a int, b int"), rows(spark, [(1, 1)], "k int, decision int"), ["k"]).orderBy("k").collect()] == [(1, 1), (2, 1)]
    assert M.pooled(rows(spark, [("a", 1), ("a", 0), ("b", 1), ("b", None)], "s string, v int"), "v", "s", rows(spark, [("a", 10), ("b", 30)], "s string, size int")).first()["share"] == 0.875
    assert M.quantiles(rows(spark, [(1.0,), (2.0,), (4.0,)], "v double"), [], "v", [0.5, 0.75]).first()["q"] == [2.0, 3.0]
    assert tuple(M.invalid_quotes(rows(spark, [("a", "abc"), ("z", "abc"), (None, "abc")], "q string, t string"), "q", "t").first()) == (2, 1)
    assert T.disagreement(t, t, "at", "label").first()["most"] == 0 and T.disagreement(t, t.where("at = 1"), "at", "label").first()["most"] is None
    p = tmp_path / "r.csv"
    p.write_text('hotel_id,source,external_review_id,text\n1,s,x,"two\nlines"\n1,s,y,ok\n', encoding="utf-8")
    assert [(r["line"], r["text"]) for r in files.numbered(spark, str(p)).orderBy("line").collect()] == [(2, "two\nlines"), (4, "ok")]
    (tmp_path / "l.txt").write_bytes("caf\u00e9".encode("latin-1"))
    (tmp_path / "u.txt").write_bytes("\ufeffcaf\u00e9".encode())
    assert {r["value"] for r in files.loose_text(spark, f"{tmp_path}/*.txt").collect()} == {"caf\u00e9"}
    files.publish(t, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2 and not list(tmp_path.glob("*.part"))
    with pytest.raises(FileExistsError):
        files.publish(t, f"file://{tmp_path}/out")
    a = files.digest_of_files(spark, f"file://{tmp_path}/*.txt")
    (tmp_path / "u.txt").write_bytes(b"other")
    assert a != files.digest_of_files(spark, f"file://{tmp_path}/*.txt")
    with pytest.raises(ValueError, match="missing columns"):
        files.import_reviews(t)
    catalog.from_frames(spark, own=t)
    catalog.register(spark)
    assert spark.sql("SELECT canonical_text('A  b') AS c, count(*) AS n FROM own").first()["c"] == "a b"
    b = R.blinded(rows(spark, [("r", i) for i in range(200)], "rater string, item int"), "rater", "item").orderBy("place").collect()
    assert 60 < sum(r["swapped"] for r in b) < 140 and [r["item"] for r in b] != list(range(200))


def test_questions_and_models(spark):
    from plumbline.operators import models as ML

    q, digest = R.question_bank(spark, {"bathroom": ("ask", "counts", "other"), "pests": ("a", "b", "c")}, "v1")
    assert q.count() == 2 and q.select("bank_sha256").distinct().first()[0] == digest != R.question_bank(spark, {"bathroom": ("ask", "counts", "other")}, "v1")[1]
    train = rows(spark, [("good lovely room", 1.0), ("bad awful room", 0.0)] * 6, "text string, label double")
    model, o = ML.chosen(train, train, [{"kind": "nb", "grams": "characters"}, {"kind": "nb"}])
    assert o == {"kind": "nb", "grams": "characters"}
    got = {r["id"]: r["predicted"] for r in ML.score(rows(spark, [(1, "lovely goods"), (2, "awfully bad"), (3, None)], "id int, text string"), model, "id").collect()}
    assert got[1] == 1 and got[2] == 0 and 3 in got


def test_retries_keep_their_state_between_batches(spark, tmp_path):
    from plumbline.streaming import events as E

    at = lambda h: datetime(2024, 1, 1, h)
    batches = [[("a", at(1), False), ("b", at(1), False), ("c", at(1), True)], [("a", at(2), False), ("b", at(2), True), ("c", at(2), False)], [("b", at(3), False), ("a", at(3), False), ("a", at(4), False), ("a", at(5), False)]]
    for i, b in enumerate(batches):
        rows(spark, b, "send_id string, at timestamp, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in.parquet/{i}")
    stream = spark.readStream.schema("send_id string, at timestamp, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in.parquet")
    got = {r["send_id"]: (r["state"], r["attempts"], r["next_attempt_at"]) for r in E.landed(E.retries(stream), ["send_id"]).collect()}
    assert got == {"a": ("failed", 5, None), "b": ("sent", 2, None), "c": ("sent", 1, None)}


def test_decisions_of_one_time_fold_alike_however_rows_lie(spark):
    log = [(1, 5, "confirmed", True), (1, 5, "confirmed", False), (1, 6, "rejected", True), (2, 5, "rejected", False), (2, 5, "confirmed", True), (3, 4, "confirmed", True)]
    findings = rows(spark, [(1, 1, "d"), (2, 1, "d"), (3, 1, "d")], "finding_id int, hotel_id int, department string")
    for order in (log, log[::-1]):
        d = rows(spark, order, "finding_id int, at int, decision string, still_open boolean").coalesce(1)
        f, t, o = ST.decided(findings, d, opened=F.col("still_open"), priority=F.lit("normal"), recipient=F.lit("desk"))
        assert {r["finding_id"]: (r["decision"], r["still_open"], r["conflict"]) for r in f.collect()} == {1: ("confirmed", False, True), 2: ("confirmed", True, True), 3: ("confirmed", True, False)}
        assert sorted(r["ticket_id"] for r in t.collect()) == sorted(r["ticket_id"] for r in o.collect()) == ["ticket-2", "ticket-3"]
