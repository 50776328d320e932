"""The pipeline against a plain version of each stage, stage by stage."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from docloom.llm import bpe, mixing, toxicity
from test_ops import brute_components, shingle_set

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    rows = {name: after.collect() for name, (_, after) in seen.items()}
    assert all(seen[n][1].columns == names for n in list(seen)[:-1])

    before, _ = seen["toxicity"]
    scorer = toxicity.Scorer(toxicity.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")))
    assert {r.doc_id for r in rows["toxicity"]} == {r.doc_id for r in before if scorer.score(r.text or "") < toxicity.REJECT_AT}

    groups = defaultdict(list)
    for r in seen["exact_dedup"][0]:
        groups[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in rows["exact_dedup"]) == sorted(max(g) for g in groups.values())

    parts = brute_components([(r.doc_id, r.text) for r in seen["near_dedup"][0]])
    assert sorted(r.doc_id for r in rows["near_dedup"]) == sorted(i for i, (_, c) in parts.items() if i == c)

    takes = {r.doc_id: r.takes for r in mixing.mix(spark.read.parquet(str(tmp_path / "near_dedup"))).collect()}
    assert Counter(r.doc_id for r in rows["mixing"]) == Counter({i: n for i, n in takes.items() if n})

    codec = bpe.ByteBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    texts = {r.doc_id: r.text for r in rows["mixing"]}
    assert len(rows["bpe"]) == len(rows["mixing"])
    assert all(r.round_trips and r.ids == codec.encode(texts[r.doc_id]) for r in rows["bpe"])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score double, takes long, cell string"


def stages(spark, tmp_path, rows):
    """Each stage's rows after rows went through the ones before, as run() does it."""
    docs, seen = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"{len(rows)}-{name}")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    return seen


def test_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = (None, "a", 3, 1.0, 1, "c")
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None, *more), (2, "", *more), (3, "x y", *more), (3, "x y", *more), (None, "x y", *more), (None, "z", *more), (None, "z", *more), (4, "x  y", *more), (5, long, *more), (6, long + " end", *more)]
    seen = stages(spark, tmp_path, rows)
    ids = lambda name: sorted((r.doc_id is None, r.doc_id, r.text) for r in seen[name])
    assert Counter(map(repr, seen["toxicity"])) == Counter(map(repr, spark.createDataFrame(rows, SCHEMA).collect()))  # one class only: nothing goes
    kept = sorted((i is None, i, t) for i, t in ((2, ""), (3, "x y"), (4, "x  y"), (5, long), (6, long + " end"), (None, "z")))
    assert ids("exact_dedup") == kept
    # 3 and 4 are the same words; 6 is a near copy of 5; a row without id stays
    assert ids("near_dedup") == [x for x in kept if x[1] not in (4, 6)]
    takes = Counter((r.doc_id, r.text) for r in seen["mixing"])
    assert set(takes) <= {(r.doc_id, r.text) for r in seen["near_dedup"]} and max(takes.values()) <= mixing.CAP
    assert all(r.round_trips and r.n_tokens == len(r.ids) for r in seen["bpe"]) and len(seen["bpe"]) == len(seen["mixing"])
    assert all(not found for found in stages(spark, tmp_path, []).values())


def test_near_copies_of_either_measure_go(spark):
    rng = random.Random(3)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(200)]
        block = [f"g{g}b{i}" for i in range(rng.randrange(20, 70))]
        edited = [w if i % 37 or i // 37 >= g % 8 else f"g{g}e{i}" for i, w in enumerate(base)]
        rows += [(len(rows) + i, " ".join(words)) for i, words in enumerate((base, base + block, edited))]
    rows += [(1000, " ".join(f"x{i}" for i in range(200))), (1001, " ".join(f"x{i}" for i in range(240)))]  # five words: 0.83, three: 0.83
    parent = {i: i for i, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    sets = [(i, shingle_set(t, 3), shingle_set(t, 5)) for i, t in rows]
    similar = lambda a, b, percent: 100 * len(a & b) >= percent * len(a | b)
    for n, (i, a3, a5) in enumerate(sets):
        for j, b3, b5 in sets[:n]:
            if similar(a3, b3, 85) or similar(a5, b5, 80):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, DIR).collect())
    assert kept == sorted(i for i in parent if find(i) == i) and 1000 in kept and 1001 not in kept
