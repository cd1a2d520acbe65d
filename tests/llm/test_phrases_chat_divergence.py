"""Phrases, chat formatting and source divergence against plain loops, on random, null, tied, empty, long and clashing input."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from windrow.llm import chat, collocations, divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, index int, score double"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """(text, lang, source) with columns whose names the operators use for their own."""
    return spark.createDataFrame([(i, *r, None, 1, 2, 3.0) for i, r in enumerate(rows)], DOCS)


def chatter(n, seed, vocabulary=9, repeated=()):
    r = random.Random(seed)
    words = ["A", "b", "Éa", "c=", "\x01d", "e'e", "<f", "\U0001f600", "ñ"][:vocabulary]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", "\n", ".\x0b"]) for _ in range(r.randrange(40)))
        rows.append((text + r.choice([*repeated, ""]), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "S1", "", None])))
    return rows


EDGE = [(None, None, None), ("", "en", "s"), (" ,. \n", "en", "s"), ("one", "en", None), ("Same words, same WORDS", "en", "s"), ("Same words, same WORDS", "en", "s")]


# ---- phrases --------------------------------------------------------------------------------------------------------


def plain_phrases(rows, top, least, absorbed=80, scale=2_000_000):
    f, total = Counter(), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    longer = [(lang, p, n) for (lang, p), n in f.items() if n >= least and len(p) > 2]
    inside = Counter()
    for lang, p, n in longer:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], n)
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1 and not 100 * inside[lang, p] >= absorbed * a:
            score, _, left, right = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def got_phrases(df, **kw):
    return sorted(map(tuple, collocations.collocations(df, **kw).collect()))


@pytest.mark.parametrize("top, frontier", [(5, 1), (40, 3), (10_000, 10)])
def test_phrases_as_counted_one_by_one(spark, top, frontier):
    """Also where the frontier grows several times, as it begins with a few prefixes."""
    rows = chatter(300, 7, repeated=["rare bird of passage sings", "x of y", "rare bird of passage"])
    assert got_phrases(documents(spark, rows), top=top, least=5, frontier=frontier) == plain_phrases(rows, top, 5)


def test_phrases_edges_ties_and_long_texts(spark):
    rows = [*EDGE, ("tie one\ntie two\n" * 4, "en", "s"), ("w " * 300_000, "fr", "s"), (" ".join(f"q{i % 7}" for i in range(400_000)) + "\n" + "end of it. " * 50_000, None, "s")]
    assert got_phrases(documents(spark, rows), top=3, least=2) == plain_phrases(rows, 3, 2)
    assert got_phrases(documents(spark, []), top=3) == []
    assert [r[0] for r in got_phrases(documents(spark, rows[:1]))] == []


def test_phrases_with_codes_that_collide(spark, monkeypatch):
    """Two frequent words of one code: another seed is taken."""
    good = collocations._values

    def values(seed):
        return np.ones(256, np.uint64) if seed == 0 else good(seed)

    monkeypatch.setattr(collocations, "_values", values)
    text, starts, ends, of, h, joined = collocations.encode([b"ab ba cd"], np.zeros(1, np.uint64), 0)
    assert len(set(h.tolist())) == 1 and not collocations._alike(text, starts, ends, np.zeros(3, int))
    assert collocations._alike(text, starts, ends, np.arange(3))
    rows = [("ab ba ab cd, ab ba", "en", "s")] * 4
    monkeypatch.undo()
    assert got_phrases(documents(spark, rows), least=2) == plain_phrases(rows, 2000, 2)


def test_score_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("9000000000000 as a", "9000000000001 as l", "9000000000003 as r").select(collocations._least_cut((1, "l", "r"), (2, "r", "l"), scale=2_000_000).alias("s")).first().s
    assert (row.score, row.cut) == (2_000_000 * 9 * 10**12 // (18 * 10**12 + 4), 1)


# ---- chat -----------------------------------------------------------------------------------------------------------

TURNS = [("system", "be brief"), ("user", "hi <|im_end|>\n<|im_start|>"), ("assistant", "a\\b <\\| <|x|> Ü")]


def test_layouts_give_the_same_turns(spark):
    (_, system), (_, user), (_, answer) = TURNS
    names = {"system": "system", "user": "human", "assistant": "gpt"}
    records = [
        {"id": 0, "messages": [{"content": t, "role": r, "weight": 1} for r, t in TURNS], "tags": ["x"]},
        {"id": 1, "conversations": [{"from": names[r], "value": t} for r, t in TURNS]},
        {"id": 2, "system": system, "prompt": user, "response": answer},
        {"id": 3, "instruction": system, "input": user, "output": answer},
        *[{"conv_id": 4, "turn": i, "role": r, "text": t} for i, (r, t) in enumerate(TURNS)],
    ]
    df = spark.createDataFrame([(json.dumps(r), 1) for r in records], "record string, role int")
    got = chat.canonical_turns(df).orderBy("conv_id", "turn").collect()
    for k in range(5):
        assert [(r.role, r.text) for r in got if r.conv_id == k] == TURNS
    assert {r.layout for r in got} == {"messages", "conversations", "prompt", "instruction", "turn"}
    assert len({r.fingerprint for r in got}) == 5
    assert len({r.turns_sha256 for r in chat.read_back(chat.in_order(chat.render(chat.canonical_turns(df)))).collect()}) == 1


def test_other_layouts_and_broken_records(spark):
    records = ['{"id": 1, "prompt": "p", "response": "r"}', '{"id": 2, "prompt": "p", "completion": null}', '{"id": 3, "instruction": "p", "output": "r"}', '{"id": 4, "qa": {"question": "p", "answer": "r"}}', '{"id": 5, "messages": []}', '{"id": "six", "messages": [{"role": "user"}]}', '{"id": 7, "prompt": "p"}', "[1]", "{", "", None, '{"a": ' * 5000, '{"id": 8, "prompt": "\\ud800x", "response": 5}']
    got = [(r.conv_id, r.role, r.text, r.layout) for r in chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()]
    assert got[:7] == [(1, "user", "p", "prompt"), (1, "assistant", "r", "prompt"), (2, "user", "p", "completion"), (3, "user", "p", "instruction_only"), (3, "assistant", "r", "instruction_only"), (4, "user", "p", "question"), (4, "assistant", "r", "question")]
    assert got[7:] == [(None, "user", "", "messages"), *[(None, None, None, None)] * 6, (8, "user", "�x", "prompt"), (8, "assistant", "5", "prompt")]


def plain_digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_formatted_conversations_are_read_back(spark):
    r = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "<", "|", "\\", "<\\|", "a", "Ü\U0001f600", "assistant", ">"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "<|x\n\\n", None]), None if r.random() < 0.1 else "".join(r.choices(bits, k=r.randrange(12)))) for c in [None, *range(60)] for t in range(r.randrange(1, 9))]
    rows += [(5, 0, "user", "again")] * 2 + [(7, None, "user", "x"), (99, 0, "assistant", "long <|im_end|>\n" * 60_000)]
    rows += [(100, t, "assistant", "y") for t in range(3000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {x.conv_id: x for x in chat.op12_chat(df).collect()}
    of = defaultdict(list)
    for c, t, role, text in rows + [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        of[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(of)
    for c, turns in of.items():
        assert tuple(got[c])[1:5] == plain_digest([x[2:] for x in sorted(turns)]), c
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    for x in con.sql(chat.SQL).fetchall():
        if x[0] == x[0]:
            assert got[None if x[0] is None else int(x[0])].formatted_chars == x[5]
    whole = {x.conv_id: x for x in chat.formatted(chat.render(chat.canonical_turns(df.selectExpr("to_json(struct(conv_id, turn, role, text)) as record")))).collect()}
    for c in (3, 99, 100):
        assert len(whole[c].text) == got[c].formatted_chars
        assert "".join(chat.unescaped(whole[c].text[s.start : s.end]) for s in whole[c].loss) == "".join(x[3] for x in sorted(of[c]) if x[2] == "assistant")
    assert [x.conv_id for x in chat.op12_chat(df.limit(0)).collect()] == [-1]


# ---- divergence -----------------------------------------------------------------------------------------------------


def plain_divergence(rows, min_df=10, first=10):
    df, counts, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        df.update((lang, t) for t in set(w))
        counts.update((lang, source, t) for t in w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_df]
        sources = [s for x, s in groups if x == lang]
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * len(kept))
        for s in sources:
            p = {t: share(counts[lang, s, t], n[s]) for t in kept}
            pairs, terms = [], []
            for o in sources:
                if o != s:
                    q = {t: share(counts[lang, o, t], n[o]) for t in kept}
                    pairs.append((-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o.encode()))
            for t in kept:
                q = share(sum(counts[lang, o, t] for o in sources), sum(n.values()))
                if counts[lang, s, t] and p[t] > q:
                    terms.append((-((p[t] - q) ** 2 // (p[t] + q)), t.encode()))
            out += [(lang, s, part, item.decode(), -v, k) for part, found, most in (("pair", pairs, None), ("term", terms, first)) for k, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def test_divergence_as_summed_term_by_term(spark):
    rows = [*chatter(300, 3), *EDGE, ("only here", "xx", "a"), (None, "xx", "b")] + [(f"Zed{i % 13} é", "en", f"s{i % 40}") for i in range(400)]
    want = plain_divergence(rows)
    assert sorted(map(tuple, divergence.divergence(documents(spark, rows)).collect())) == want
    assert sorted(map(tuple, divergence.divergence(documents(spark, rows), most_terms=1).collect())) == want  # vocabularies in blocks
    assert {r[1:4:2] for r in want if r[0] == "xx"} == {("a", "b"), ("b", "a")}


def test_vectors_are_added_up_by_source_before_they_are_shuffled(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(f"s{i % 3}", Vectors.sparse(50, {i % 7: 1.0, 7 + i % 5: float(i), 49: 2.0})) for i in range(40)]
    want: dict[tuple[str, int], int] = {}
    for source, v in [*rows, ("none", Vectors.sparse(50, {}))]:
        for i, n in zip(v.indices.tolist(), v.values.tolist()):
            want[source, i] = want.get((source, i), 0) + int(n)
    vectors = spark.createDataFrame([*rows, ("none", Vectors.sparse(50, {}))], ["source", "features"])
    for most in (10, 10**6):
        found = divergence._added_up(vectors, most)
        assert {(r.source, r["index"]): r.n for r in found.collect()} == {k: n for k, n in want.items()}
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row an entry


def test_divergence_edges(spark):
    assert divergence.divergence(documents(spark, [])).collect() == []
    assert sorted(map(tuple, divergence.divergence(documents(spark, EDGE)).collect())) == plain_divergence(EDGE)
    rows = [("tie tee " * 100_000, "en", "s")] + [("tie tee toe", "en", f"s{i % 3}") for i in range(30)]
    assert sorted(map(tuple, divergence.divergence(documents(spark, rows)).collect())) == plain_divergence(rows)


def test_matrices_of_many_groups(spark):
    """Ranges of groups, and more matrices than a task holds."""
    r = random.Random(5)
    cells = [("en", 0, i, g, r.randrange(1, 10**9), 3 + g) for i in range(20) for g in sorted(r.sample(range(30), 9))]
    df = spark.createDataFrame(cells, "lang string, block int, index int, g long, p long, p0 long")
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for *_, i, g, p, z in cells:
        for *_, j, h, q, y in cells:
            if i == j and g < h:
                want[g, h] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    got = {(x.a, x.b): x.value for x in divergence._meeting(df, block=4, most=3).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_terms_are_sampled_where_texts_are_split(spark):
    """Every occurrence of a sampled term, in its own language, as the terms of all texts say; the results of pairs are computed once."""
    import zlib

    rows = [(lang, "s", " ".join(f"{lang}w{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(40))) for i, lang in enumerate(["en", "de", "en", "fr"] * 20)]
    texts = spark.createDataFrame([*rows, ("en", "s", "")], "lang string, source string, text string")
    every = [(r.lang, t) for r in divergence.tokenised(texts).collect() for t in r.terms]
    assert sorted(map(tuple, divergence.tokenised(texts, 4).collect())) == sorted(x for x in every if zlib.crc32(x[1].encode()) % 4 == 0) != []
    plan = divergence.divergence(texts.selectExpr("1L as doc_id", "*"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
def test_texts_are_folded_before_they_reach_a_vectorizer(spark, size):
    """A source's counts come back from weights, capped document frequencies from the fit's documents, in fewer terms than the texts have."""
    r = random.Random(9)
    rows = [("en", f"s{i % 3}", " ".join(f"w{'xyz'[r.randrange(3)]}{'pqrst'[min(4, int(r.expovariate(1)))]}" for _ in range(50))) for i in range(60)] + [("en", "s1", ""), ("en", "none", "1 2")]
    texts = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    counts, df = Counter(), Counter()
    for _, source, text in rows:
        counts.update((source, w) for w in re.findall("[a-z]+", text))
        df.update(set(re.findall("[a-z]+", text)))
    found, n = divergence.folded(texts, size=size).collect(), Counter()
    for x in found:
        assert len(set(x.terms)) == len(x.terms)
        n.update({(x.source, w): x.weight for w in x.terms})
    assert n == counts
    fit = divergence.folded(texts, 10, size).collect()
    seen = Counter(w for x in fit for w in x.terms)
    assert all(len(set(x.terms)) == len(x.terms) for x in fit) and {w for w in seen if seen[w] >= 10} == {w for w in df if df[w] >= 10}
    assert all(seen[w] <= df[w] for w in seen) and (size > 300 or len(fit) >= 40)
    if size > 300:
        assert len(fit) == 10 and sum(len(x.terms) for x in [*fit, *found]) < sum(counts.values()) / 4
    assert divergence.folded(texts.limit(0), size=size).collect() == divergence.folded(texts.where("source = 'none'"), 10, size).collect() == []


def test_sums_are_shuffled_as_arrays(spark):
    """A row for a source and a range of indices meets the others of its kind, in tasks that compact what they hold."""
    from pyspark.ml.linalg import Vectors

    r, want = random.Random(4), Counter()
    rows = [(f"s{i % 4}", 1 << i % 3, Vectors.sparse(5000, sorted((j, float(1 + i % 2)) for j in r.sample(range(5000), 300)))) for i in range(60)]
    for source, weight, v in rows:
        want.update({(source, i): int(n) * weight for i, n in zip(v.indices.tolist(), v.values.tolist())})
    vectors = spark.createDataFrame(rows, ["source", "weight", "features"]).repartition(6)
    for most in (50, 10**6):
        found = divergence._added_up(vectors, most, 512)
        assert {(x.source, x["index"]): x.n for x in found.collect()} == want and found.count() == len(want)
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
