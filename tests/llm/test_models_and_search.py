"""Operators 2, 4, 9 and the pipeline."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_classifier, tool_calls, toxicity
from quarry.llm.common import held_out

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def auc(y, s):
    y, s = np.array(y), np.array(s)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2) if len(a) and len(b) else 1.0


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.85), (quality_classifier, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = tables(spark)
    out = module.score(docs, module.fit(docs, labels))
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([r[label] for r in held], [r.score for r in held]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_scores_of_odd_tables(spark, module):
    docs, labels = tables(spark)
    model = module.fit(docs.limit(60), labels)
    odd = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (None, "some text", "c"), (3, "!!! ...", "d"), (3, "!!! ...", "d"), (4, "word " * 20000, "e")], "doc_id long, text string, score string")
    rows = module.score(odd, model).collect()
    assert len(rows) == 6 and all(r.score is not None for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert rows[0].score == rows[1].score
    assert module.score(odd.limit(0), model).count() == 0
    kept = module.score(odd, model, keep=["text"])
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r in odd.collect())
    none = module.fit(docs, spark.createDataFrame([], labels.schema))
    assert module.score(odd, none).count() == 6


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.arange(14)[:, None], rng.integers(0, 9, (14, 3))], axis=1).astype(np.int32)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"][:20] = rng.standard_normal((20, toxicity.SIZE))
    start, length, y, w = np.array([0, 5, 9]), np.array([5, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        p, _ = net.forward(x, start, length)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    _, saved = net.forward(x, start, length, keep=True)
    grads = net.backward(x, y, w, saved)
    for k in ("word", "tri", "wf", "ub", "cb", "wa", "va", "wo", "co"):
        for at in [tuple(int(rng.integers(0, min(n, 9))) for n in net.p[k].shape) for _ in range(4)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-3
            up = loss()
            net.p[k][at] = old - 1e-3
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-4, (k, at)


def test_windows_cover_all_words():
    start, length, doc = toxicity.windows(np.array([0, 0, 5, 37, 137]))
    for d, (a, b) in enumerate([(0, 0), (0, 5), (5, 37), (37, 137)]):
        seen = {w for s, k, o in zip(start, length, doc, strict=True) if o == d for w in range(s, s + k)}
        assert seen == set(range(a, b))


def test_tool_calls(spark):
    schema = {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1}, "s": {"type": "string", "enum": ["a", "b"], "pattern": "^[a-z]$"}}}
    rows = [
        ("s", "a", "f", '{"s": "a", "x": 1}', None, 1),
        ("s", "b", "f", '{"x":0,"y":[1, {"b":1,"a":2}]}', ["a"], 1),
        ("s", "c", "f", "[1]", ["a", "b", "gone", None], 1),
        ("s", "d", "g", "{}", ["e"], 1),
        ("s", "e", "f", "not json", ["d"], 1),
        ("s", "k", "f", None, ["d"], 1),
        ("t", "a", "f", '{"x":"1","s":"zz"}', ["c"], 1),
        (None, "a", "f", '{"x":2}', ["a"], 1),
        ("s", 'q"', "f", '{"x":2}', None, 1),
        ("s", 'q"', "f", '{"x":2}', None, 1),
    ]
    calls = spark.createDataFrame(rows, "scope string, id string, name string, arguments string, after array<string>, level int")
    results = spark.createDataFrame([("s", "a", "r1"), ("s", "a", "r2"), ("s", "zz", "r"), (None, "a", "r")], "scope string, id string, content string")
    out = {(r.scope, r.id): r for r in tool_calls.link(calls, results, {"f": schema}).collect()}
    assert tool_calls.link(calls, results, {"f": schema}).count() == len(rows)
    assert {k: r.level for k, r in out.items()} == {("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 2, ("s", "d"): None, ("s", "e"): None, ("s", "k"): None, ("t", "a"): 0, (None, "a"): 0, ("s", 'q"'): 0}
    assert out["s", "a"].n_results == 2 and out["s", "b"].n_results == 0
    assert out["s", "a"].valid and not out["s", "a"].errors
    assert set(out["s", "b"].errors) == {"$.x: minimum", "$: additionalProperties"}
    assert set(out["s", "c"].errors) == {"$: type"} and out["s", "d"].errors == ["$: unknown tool"] and out["s", "e"].errors == ["$: json"]
    assert set(out["t", "a"].errors) == {"$.x: type", "$.s: enum", "$.s: pattern"}
    assert out["s", "b"].json == '{"arguments":{"x":0,"y":[1,{"a":2,"b":1}]},"id":"b","name":"f"}'
    assert json.loads(out["s", 'q"'].json) == {"arguments": {"x": 2}, "id": 'q"', "name": "f"}
    assert tool_calls.unmatched(calls, results).count() == 2
    assert tool_calls.link(calls.limit(0), results.limit(0), {"f": schema}).count() == 0


def test_schema_keywords(spark):
    """Each keyword by a value that fits and one that doesn't; keywords that aren't read are refused."""
    cases = [
        ({"type": "integer"}, ["1", "1.0", "12345678901234567890", "-3"], ["1.5", '"1"', "true"]),
        ({"type": ["null", "boolean"]}, ["null", "true"], ["0"]),
        ({"items": {"type": "integer"}}, ["[]", "[1,2]", '"no array"'], ['[1,"x"]', "[null]"]),
        ({"minItems": 1, "maxItems": 2}, ["[1]", "[1,2]", "{}"], ["[]", "[1,2,3]"]),
        ({"const": {"a": [1]}}, ['{"a":[1]}'], ['{"a":[2]}', "1"]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"a"', "7"], ["3"]),
        ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, ["3"], ["7"]),
        ({"allOf": [{"type": "number"}, {"minimum": 5}]}, ["7"], ["3", '"a"']),
        ({"not": {"type": "string"}}, ["1"], ['"a"']),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, ["2"], ["1", "3"]),
        ({"multipleOf": 0.5}, ["1.5", "2"], ["1.3"]),
        ({"minProperties": 1, "maxProperties": 1}, ['{"a":1}', "[]"], ["{}", '{"a":1,"b":2}']),
        ({"properties": {"a": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, ['{"a":1,"b":"x"}', "[]"], ['{"a":1,"b":2}']),
        ({"properties": {"a": {"items": {"properties": {"b": {"maxLength": 1}}}}}}, ['{"a":[{"b":"x"}]}'], ['{"a":[{"b":"xy"}]}']),
        ({"properties": {"a": False}}, ["{}"], ['{"a":1}']),
        ({"title": "t", "description": "d"}, ["1"], []),
    ]
    for k, (schema, good, bad) in enumerate(cases):
        rows = spark.createDataFrame([(v,) for v in good + bad], "j string").select("j", tool_calls.schema_errors(F.try_parse_json("j"), schema).alias("e"))
        got = {r.j: r.e for r in rows.collect()}
        assert all(not got[v] for v in good) and all(got[v] for v in bad), (k, got)
    with pytest.raises(ValueError, match="prefixItems"):
        tool_calls.schema_errors(F.lit(None), {"properties": {"a": {"prefixItems": []}}})


def test_levels_of_a_long_chain(spark):
    calls = spark.range(20000).select(F.lit("s").alias("scope"), F.col("id").cast("string").alias("id"))
    edges = calls.select("scope", "id", (F.col("id").cast("long") - 1).cast("string").alias("after"))
    assert tool_calls.levels(calls, edges).where("level <> cast(id as long)").count() == 0


def test_conversations_with_nulls(spark):
    turns = spark.createDataFrame([(1, 0, "user", None, 0), (1, 1, "assistant", "x", 0), (None, 0, "user", "a", 0), (2, None, "user", "", 0), (1, 2, "user", "y" * 2000, 0), (1, 0, "user", None, 0)], "conv_id long, turn long, role string, text string, id int")
    rows = tool_calls.conversation_calls(turns).collect()
    assert len([r for r in rows if r.role == "call"]) == 5 and tool_calls.conversation_calls(turns.limit(0)).count() == 0
    assert [(r.conv_id, r.id, r.level, r.valid, json.loads(r.json)["content"]) for r in rows if r.role == "result"] == [(1, "1:0", 0, True, "x")]
    assert {(r.id, r.level, r.n_results) for r in rows if r.conv_id == 1 and r.role == "call"} == {("1:0", 0, 1), ("1:2", 1, 0)}


def test_results_reach_the_output(spark):
    """Each result once, with its content and its call's level; those without a call too."""
    calls = spark.createDataFrame([("s", "a", "f", "{}", None), ("s", "b", "f", "{}", ["a"]), ("s", "b", "f", "{}", None), (None, "a", "f", "{}", None)], "scope string, id string, name string, arguments string, after array<string>")
    rows = [("s", "b", 'say "é"\n{x}'), ("s", "b", None), ("s", "zz", "orphan"), (None, "a", "no scope"), ("t", "a", "far")]
    results = spark.createDataFrame(rows, "scope string, id string, content string")
    out = tool_calls.messages(tool_calls.link(calls, results, {"f": {}}), results).collect()
    got = {(r.scope, r.id, json.loads(r.json)["content"], r.level, r.linked) for r in out if r.role == "result"}
    assert got == {(*rows[0], 1, True), (*rows[1], 1, True), (*rows[2], None, False), (*rows[3], None, False), (*rows[4], None, False)}
    assert sorted((r.id, r.level, r.linked) for r in out if r.role == "call") == [("a", 0, False), ("a", 0, False), ("b", 1, True), ("b", 1, True)] and len(out) == 9


def test_levels_are_depths(spark):
    """Conversations' levels are depths, not turns; other dependencies by a plain version, with cycles and a long chain."""
    turns = spark.createDataFrame([(1, t, "user" if t not in (3, 7, 8) else "assistant", "x") for t in range(11)], "conv_id long, turn long, role string, text string")
    assert {r.id: r.level for r in tool_calls.conversation_calls(turns).collect() if r.role == "call"} == {"1:0": 0, "1:1": 1, "1:2": 2, "1:4": 3, "1:5": 4, "1:6": 5, "1:9": 0, "1:10": 1}
    rng = np.random.default_rng(3)
    after = {("r", str(i)): {str(j) for j in rng.integers(0, 40, 2) if j < i or rng.random() < 0.02} for i in range(40)}
    after |= {("l", str(i)): {str(i - 1)} if i else set() for i in range(300)} | {("c", "a"): {"b"}, ("c", "b"): {"a", "d"}, ("c", "d"): set(), ("c", "e"): {"a", "d"}}
    want: dict = {}
    while more := {k: 1 + max((want[k[0], d] for d in ds), default=-1) for k, ds in after.items() if k not in want and all((k[0], d) in want for d in ds)}:
        want |= more
    calls = spark.createDataFrame(list(after), "scope string, id string")
    edges = spark.createDataFrame([(s, i, d) for (s, i), ds in after.items() for d in ds], "scope string, id string, after string")
    assert {(r.scope, r.id): r.level for r in tool_calls.levels(calls, edges).collect()} == {k: want.get(k) for k in after}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns and 0 < after.count() <= before.count(), name
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert out.count() == before.count()
    # the groups and spans of the stages' results, by plain versions
    from tests.llm.test_text_operators import brute_secrets, linked_components

    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert all(not [s for s in brute_secrets(t) if "[SECRET]" not in t[s[1] : s[2]]] for _, t in rows)
    assert len({c for _, _, c in linked_components(rows)}) == len(rows)
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert len(clean & {r.doc_id for r in first.select("doc_id").collect()}) >= 0.95 * len(clean)


def test_rows_of_one_id_are_grouped_by_their_texts(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("one", "two"))
    rows = [(1, a, "x"), (7, a.replace("one3 ", "other "), "x"), (7, b, "y"), (7, b, "x"), (8, b, "x"), (9, None, "x"), (9, "", "x"), (None, a, "x")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[3], rows[5], rows[6], rows[7]], key=str)


def test_pipeline_of_odd_tables(spark):
    import corpus_pipeline

    prose = "The quick brown fox, as we know, jumps over the lazy dog; it rains. Nobody minds, since the fox is quick and the dog sleeps on."
    rows = [(1, prose, "a", {"k": 1}), (1, prose, "a", {"k": 1}), (2, prose, "b", {"k": 2}), (3, None, "c", None), (4, "", "c", {}), (None, prose + " More.", "d", {}), (5, prose + " token = abcdef123 " + "far away words " * 30000, "e", {}), (6, "one two", None, None)]
    schema = "doc_id long, text string, row_key string, `score` map<string,int>"
    odd = spark.createDataFrame(rows, schema)
    steps = dict(corpus_pipeline.STAGES)
    for table in (odd, odd.limit(0)):
        docs = table
        for name in ("toxicity", "quality"):
            out = steps[name](spark, docs, DATA)
            assert out.columns == odd.columns and out.count() <= docs.count()
        docs = steps["near_copies"](spark, docs, DATA)
        kept = sorted((str(r.doc_id), (r.text or "")[:8]) for r in docs.collect())
        assert docs.columns == odd.columns and (not kept or [i for i, _ in kept] == ["1", "3", "4", "5", "6", "None"])
        masked = steps["secrets"](spark, docs, DATA)
        texts = {r.doc_id: r.text for r in masked.collect()}
        assert masked.columns == odd.columns and (not texts or (texts[3] is None and texts[4] == "" and "abcdef123" not in texts[5] and texts[1] == prose))
        assert sorted(str(r.doc_id) for r in steps["packing"](spark, masked, DATA).collect()) == [i for i, _ in kept]


def test_held_out_of_null_ids(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out()).first()[0] is False


def test_quality_is_a_plain_vote(spark):
    """Scores against neighbours found one by one, with all ties of the last one."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["rain", "Fox,", "dog", "runs.", "x9", "!!"], rng.integers(1, 30))) for _ in range(90)]
    texts[40:60] = texts[:20]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    counts = quality_classifier.term_counts(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    y = rng.integers(0, 2, 60)
    model = quality_classifier.Model(counts[:60].copy(), y.astype(np.float32))
    got = model.score(counts)
    for k, v in enumerate(model.project(counts)):
        sims = [round(float(v @ u), 6) for u in model.vectors]
        least = sorted(sims)[-quality_classifier.NEIGHBOURS]
        near = [(max(float(s), 0) ** quality_classifier.SHARPNESS, y[i]) for i, s in enumerate(sims) if s >= least - 1.5e-6]
        assert abs(got[k] - sum(w * b for w, b in near) / sum(w for w, _ in near)) < 0.02
    words = [t.lower().split() for t in texts]
    assert all(counts[i, quality_classifier.FAMILIES[1][0] : quality_classifier.FAMILIES[1][1]].sum() == len(w) for i, w in enumerate(words))
    assert all(counts[i, quality_classifier.FAMILIES[2][0] :].sum() == sum(max(0, len(x) - 2) for x in w) for i, w in enumerate(words))


def test_toxicity_is_the_highest_window(spark):
    """Scores of texts against each window by itself, by a plain recurrence."""
    rng = np.random.default_rng(1)
    net = toxicity.Network(3)
    for v in net.p.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * 0.3
    text = " ".join(rng.choice(["bad", "Good", "words", "é1"], 75)).encode()
    x, at = toxicity.inputs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    sig, p, h = lambda z: 1 / (1 + np.exp(-z)), net.p, toxicity.HIDDEN

    def window(rows):
        e = p["word"][rows[:, 0]] + sum(p["tri"][rows[:, k]] for k in (1, 2, 3))
        states = []
        for side, order in (("f", range(len(e))), ("b", range(len(e) - 1, -1, -1))):
            s, out = np.zeros(h), {}
            for t in order:
                a, b = e[t] @ p[f"w{side}"] + p[f"c{side}"], s @ p[f"u{side}"]
                z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                s = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * s
                out[t] = s
            states.append(np.array([out[t] for t in range(len(e))]))
        state = np.concatenate(states, axis=1)
        weight = np.exp(np.tanh(state @ p["wa"] + p["ca"]) @ p["va"])
        return float(sig((weight / weight.sum()) @ state @ p["wo"] + p["co"][0]))

    starts = [*range(0, 75 - toxicity.WINDOW, toxicity.STRIDE), 75 - toxicity.WINDOW]
    assert len(x) == 75 and abs(net.score_texts(x, at)[0] - max(window(x[s : s + toxicity.WINDOW]) for s in starts)) < 1e-4
