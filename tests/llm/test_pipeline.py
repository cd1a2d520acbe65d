"""The pipeline's stages on planted cases, and its contract."""

import corpus_pipeline as cp
import pandas as pd
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, DATA)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5] > 0
    assert docs.where("doc_id is null or n_tokens = 0").count() == 0
    final = spark.read.parquet(str(tmp_path / "decontamination")).toPandas()
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    texts = [" ".join(t.split()) for t in final.text]
    assert not [q for q in bench.text if any(" ".join(q.split()) in t for t in texts)]


def test_stages_take_empty_tables_and_nulls(spark):
    for rows in ([], [(None, None, None, None, None)], [(1, None, None, None, None), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in cp.STAGES:
            assert stage(spark, docs.withColumn("h", F.lit(1)), DATA).count() <= len(rows), name


def test_run_is_the_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "bpe"]


def test_similar_texts_that_share_no_block(spark):
    """Every pair of texts of the asked similarity is in one component, by brute force, also where an edit spoils the only block."""
    import random

    from windrow.llm.simhash import near_duplicates

    rng = random.Random(3)
    texts = []
    for n in [30, 34, 40, 46, 60, 90] * 6:
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for at in (0, n - 1, n // 2)[: rng.randrange(1, 4)]:
            texts.append(" ".join([*words[:at], f"x{rng.randrange(10**6)}", *words[at + 1 :]]))
    texts += ["a b c", "a b c d", None, ""]
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    component = {r.id: r.component for r in near_duplicates(df, similarity=0.8).collect()}
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 40 and all(component[i] == component[j] for i, j in alike)
    assert len({component[i] for i in range(len(texts))}) >= 36  # different texts stay apart


def test_a_seed_of_many_documents_is_linked_without_a_join(spark):
    """Parts of a frequent seed lead to the least document of all through a window over one row a part and place."""
    from windrow.llm.substring import linked

    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(1, 2501).selectExpr("id as doc", f"concat('{line} u', id) as text")
    found = linked(docs, 4, 4, 40, 12)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    seeds = found.where("doc = 2500").select("p", "long").distinct().count()
    assert found.select("doc").distinct().count() == 2499 and found.where("src = 1").select("doc").distinct().count() > 100
    assert found.where("src >= doc").isEmpty() and found.count() <= 2 * 2499 * seeds


def test_written_tables_leave_no_shuffle_files(spark):
    """What was shuffled on the way to a written table goes with the write, not whenever the driver collects its garbage."""
    import time

    from windrow.shared import written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, before = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(key)

    def files() -> set[str]:
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    old, held = files(), spark.range(100_000).repartition(4, "id")
    written(held)
    assert spark.conf.get(key) == before
    for _ in range(50):
        if files() <= old:
            break
        time.sleep(0.2)
    assert files() <= old


def test_rest_edges_of_texts_with_frequent_grams(spark):
    """Grams that many texts have, collected for their order, don't take the place of the texts; an alike pair without a root is linked."""
    from windrow.llm.simhash import rest_edges, sketches

    common = " ".join(f"c{i}" for i in range(10))
    texts = [f"{common} " + " ".join(f"w{n}x{i}" for i in range(40)) for n in range(12)]
    texts.append(texts[0] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sketches(docs, "doc_id", "text", 3).localCheckpoint()
    fp = {r.id: r.fp for r in found.collect()}
    roots = spark.createDataFrame([], "fp long, root long")
    edges = {frozenset(r) for r in rest_edges(found, roots, docs, "doc_id", "text", 0.8, one_doc_in=1).collect()}
    assert edges == {frozenset((fp[0], fp[12]))}


def test_seeds_in_buckets_are_the_same_in_fewer_bytes(spark):
    """Seeds dealt out by bucket are those made a row each, in under half of a row's 40 bytes, and lead where all pairs say."""
    import random

    import numpy as np
    from windrow.llm.substring import holders, opened, seeds

    rng = random.Random(5)
    rows = [(i * 10**15 - 7, " ".join(f"w{rng.randrange(40)}" for _ in range(400))) for i in range(1, 60)]
    docs = spark.createDataFrame([*rows, (3, ""), (4, "one")], "doc long, text string").coalesce(1)
    plain = sorted(map(tuple, seeds(docs, 4, 4, 40, 12).collect()))
    packed = seeds(docs, 4, 4, 40, 12, None, 7).toArrow()
    assert sorted(zip(*(c.tolist() for c in opened(packed)))) == plain and len(set(packed["bucket"].to_pylist())) == 7
    near = seeds(docs.selectExpr("doc div 1000000000000000 as doc", "text"), 4, 4, 40, 12, None, 7).toArrow()
    assert sum(len(v) for c in ("h", "part", "doc", "pos") for v in near[c].to_pylist()) < 20 * len(plain)

    few, h = 4, np.array([rng.randrange(60) for _ in range(500)], np.int64)
    part, doc, pos = (np.array([rng.randrange(n) for _ in h], t) for n, t in ((2, np.int32), (9, np.int64), (50, np.int32)))
    part[h > 20] = 0
    want, at = [], list(zip(h.tolist(), part.tolist(), doc.tolist(), pos.tolist()))
    for a, p, d, x in at:
        same = sorted((e, y) for b, q, e, y in at if (a, p) == (b, q))
        often, before = p > 0 or len(same) > few, [s for s in same if s[0] < d]
        to = before if not often else sorted({min(before), min(s for s in before if s[0] == before[-1][0])}) if before else []
        if before or p > 0 or (often and len(same) > 1 and a % 2 == 0):
            if before or (p > 0 and not before) or a % 2 == 0:
                want.append((a if often else None, d, x, a % 2 == 1, p > 0 and not before, [tuple(s) for s in to]))
    got = [(r["h"], r["doc"], r["pos"], r["long"], r["least"], sorted((s["doc"], s["q"]) for s in r["s"])) for r in holders(h, part, doc, pos, few).to_pylist()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pairs_that_parities_tell_apart_are_not_verified(spark, monkeypatch):
    """Of texts that share a rare gram only those near enough by parities meet with all their grams; bounds are no more than the sets' difference."""
    import random

    import numpy as np
    from windrow.llm import simhash

    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 63, 64, 65, 300, 3000):
        for m in (n, n + 1, n // 2, 4 * n):
            x = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
            y = np.unique(np.concatenate([x[: rng.integers(0, n + 1)][:m], rng.integers(0, 2**64 - 1, m, np.uint64)]))
            least = simhash.apart(simhash.parities(x), simhash.parities(y))
            assert least == simhash.apart(simhash.parities(y), simhash.parities(x)) <= len(np.setxor1d(x, y))
        assert simhash.apart(simhash.parities(x), simhash.parities(x)) == 0

    held, real = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *rest: held.append(pairs.count()) or real(pairs, *rest))
    r = random.Random(11)
    words = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    texts = [" ".join([*w[:30], "of", "one", "rare", "saying", "only", *w[30:]]) for w in words]
    texts += [f"{texts[0]} more", f"{texts[1]} and more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.sketches(docs, "doc_id", "text", 3).localCheckpoint()
    fp = {x.id: x.fp for x in found.collect()}
    edges = simhash.rest_edges(found, spark.createDataFrame([], "fp long, root long"), docs, "doc_id", "text", 0.8, least=10**9)
    assert {frozenset(e) for e in edges.collect()} == {frozenset((fp[0], fp[40])), frozenset((fp[1], fp[41]))}
    assert held == [2]
