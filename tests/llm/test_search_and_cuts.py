"""Bit-sliced search, source divergence and fill-in-the-middle: brute force, round trips, SQL and awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumispark.llm import bitslice, divergence, infill
from lumispark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import AWKWARD, documents, write
from tests.test_queries import canonical

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_bitslice", "op12_divergence", "op13_infill"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


# ---- bit-sliced search


def test_adder_and_selection():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (3, 40, 200)).astype(bool)  # queries, addends, rows
    power = rng.integers(0, 6, 40)
    adder = bitslice.Adder()
    for i in range(40):
        adder.add(int(power[i]), bitslice._packed(x[:, i]))
    slices, sums = adder.total(), (x << power[None, :, None]).sum(axis=1)
    bits = lambda s: np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :200].astype(np.int64)
    assert (sum(bits(s) << p for p, s in enumerate(slices)) == sums).all()
    some = rng.integers(0, 2, (3, 200)).astype(bool)
    for k in (1, 5, 60, 199):
        want = [np.sort(s[m])[::-1][k - 1] if m.sum() >= k else 0 for s, m in zip(sums, some, strict=True)]
        value = bitslice.kth_value(slices, bitslice._packed(some), k)
        assert value.tolist() == want
        assert (bits(bitslice.at_least(slices, bitslice._packed(some), value)) == (some & (sums >= value[:, None]))).all()


def brute(rows, k=5, every=50):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            most = math.isqrt((2**63 - 1) // max(1, len(v)))
            whole.setdefault(i, []).append([int(max(-most, min(most, np.floor(x * 256.0)))) for x in v])
    out = []
    for i, vs in whole.items():
        for q in {tuple(v) for v in vs} if i % every == 0 else ():
            found = [(-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, cs in whole.items() if j != i for c in cs if len(c) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["mixed", "copies", "coarse", "far"])
def test_bitslice_equals_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(bitslice, "BLOCK", 64)  # on the driver: it deals rows to blocks
    monkeypatch.setattr(bitslice, "QUERIES", 3)
    n, d = 400, 6
    x = rng.normal(size=(n, d)) * {"mixed": 0.4, "copies": 0.4, "coarse": 0.004, "far": 1.0}[kind]
    if kind == "copies":
        x[: n // 3] = x[0]
    if kind == "far":
        x *= 10.0 ** rng.integers(-3, 14, size=(n, 1))
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    if kind == "mixed":
        rows += [(50, rows[50][1]), (51, rows[50][1]), (None, rows[0][1]), (1000, None), (1001, [None] * d), (1050, [float("nan")] * d), (1100, [0.0] * d), (1150, [1.0, 2.0]), (1200, []), (1201, []), (1250, [1e300] * d), (1300, [float("inf")] * d)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = bitslice.search(df, df.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bitslice_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [0.5, 0.5], "b")], "vec_id long, embedding array<double>, score string")
    assert [tuple(r) for r in bitslice.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert bitslice.search(df.limit(0), df).count() == 0 and bitslice.search(df, df.limit(0)).count() == 0


# ---- divergence


def test_forest_shares_nodes_and_prices_pairs():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (7, 256)) * (rng.random((7, 256)) < 0.1)
    counts[5] = counts[2]
    counts[:, 200:] = divergence.NONE
    forest = divergence.Forest(counts)
    assert forest.roots[5] == forest.roots[2]
    assert len(forest.levels[0][0]) <= 16  # pairs of four values at most, of 7 * 128 places
    whole = counts.clip(0).sum(axis=1) + 5 * 200
    left, right = np.triu_indices(7, 1)
    met = []

    def price(pair, a, b):
        met.append(len(pair))
        return np.where(a == divergence.NONE, 0, abs(divergence.share(a, whole[left[pair]]) - divergence.share(b, whole[right[pair]])))

    want = [sum(abs((10**9 * (int(x) + 5)) // int(whole[i]) - (10**9 * (int(y) + 5)) // int(whole[j])) for x, y in zip(counts[i, :200], counts[j, :200], strict=True)) for i, j in zip(left, right, strict=True)]
    assert forest.totals(left, right, price).tolist() == want
    assert sum(met) <= len(left) * 10  # of 256 leaves a pair of trees has nine distinct ones and the filling
    at, own, its = forest.leaves(1, 4)
    assert sorted(at) == np.flatnonzero(counts[1] > 0).tolist() and (counts[1][at] == own).all() and (counts[4][at] == its).all()


def test_share_is_exact():
    for c, w in ((0, 5), (10**13, 3 * 10**15), (0, 8 * 10**15), (7, 12), (10**9, 10**9 + 5)):
        assert divergence.share(np.array([c]), w)[0] == 1 + 10**9 * (c + 5) // w


def audit_by_hand(rows, least, top):
    docs = [((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), lang or "", s or "") for _, t, lang, s in rows]
    seen, count, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for t, lang, s in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        groups[lang].add(s)
        seen.update({(lang, w) for w in words})
        count[lang, s].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in seen.items() if x == lang and n >= least]
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        of = {s: p(count[lang, s]) for s in sources}
        q = p(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(of[s][w] - of[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(q[w] - of[s][w], w) for w in kept if count[lang, s][w] and of[s][w] > q[w]]
            out += [(lang, s, part, i, -v, r + 1) for part, found, most in (("pair", pair, None), ("term", term, top)) for r, (v, i) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile"), [(4096, 64), (3, 2), (1, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, tile):
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "GAMMA", "délta", "É", "x", "日本", "\U0001f600", "rare", "zz"]
    rows = []
    for i in range(160):
        some = rng.choice(words, size=rng.integers(0, 12), p=np.array([9, 8, 7, 5, 4, 3, 3, 2, 0.2, 1]) / 42.2)
        rows.append((i, "1, ".join(some) + "!" if i % 9 else None, [None, "en", "de"][i % 3], ["a", "b", None, "é", "E", "c"][rng.integers(0, 6)]))
    rows += [(1, "the same", "fr", "a")] * 3 + [(2, "", "it", "only")]
    df = spark.createDataFrame(rows, "value long, text string, lang string, source string").repartition(5)  # a clashing name
    assert sorted(map(tuple, divergence.audit(df, least=3, top=4, block=block, tile=tile).collect())) == audit_by_hand(rows, 3, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_long_texts_are_counted_whole(spark):
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200_000))
    got = {(r["term"]): (r["n"], r["docs"]) for r in divergence.count_terms(spark.createDataFrame([("", "", text), ("", "", "Waa waa")], "lang string, source string, text string")).collect()}
    assert len(got) == 676 and got["waa"] == (text.count("waa") + 2, 2) and sum(n for n, _ in got.values()) == 200_002


# ---- fill in the middle


def test_rank_index_is_exact():
    rng = np.random.default_rng(11)
    texts = ["", " ", "one", "  one two\t", "a" * 5000 + " b " * 3000 + "c" * 70_000 + " d", "", " ".join("x" * int(n) for n in rng.integers(1, 40, 20_000)), "é\U0001f600   z"]
    offsets, edges = infill.boundaries(texts)
    index = infill.RankIndex(offsets, edges)
    assert (index.offset_of(np.arange(len(offsets))) == offsets).all()
    assert len(index.first) < len(offsets) / 20
    for t, a, b in zip(texts, edges, edges[1:], strict=False):
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        assert offsets[a:b].tolist() == np.cumsum([0, *map(len, tokens)]).tolist()


def infilled(i, t):
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    t = t or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    low, high = sorted(x % (len(tokens) + 1) for x in (h1, h2))
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, t
    return len(tokens), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_infill_equals_brute_force(spark):
    rows = [*AWKWARD, *((100 + i, f" tokens {'é' * (i % 7)} and\n{i} more \t" * (i % 5) + "<" * (i % 3) + "S>"[i % 2 :], "a") for i in range(300)), (900, "has <P> in it", "a"), (901, "x " * 400_000, "a")]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "output").repartition(3)  # a clashing name
    out = infill.transform(docs)
    got = out.withColumn("back", infill.restore(out["output"], out["form"])).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == infilled(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert infill.transform(docs.limit(0)).count() == 0


def test_infill_cuts_of_batches(spark):
    texts = ["a b c"] * 3 + ["", "d"]
    cuts = infill._cuts.func(pa.array(texts), pa.array([0, 1, 9, 0, 1]), pa.array([3, 2, 4, 5, 0]))
    assert cuts.to_pylist() == [{"n": n, "low": a, "high": b} for n, a, b in ((3, 0, 5), (3, 1, 3), (3, 0, 1), (0, 0, 0), (1, 0, 1))]


def test_queries_on_awkward_tables(spark, tmp_path):
    sf = write(spark, tmp_path, documents=documents(spark, AWKWARD), embeddings=spark.createDataFrame([(0, None), (50, [1.0]), (50, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in QUERIES["op11_bitslice"](spark, sf).collect()] == [(50, 1, 7, 131072)]
    assert QUERIES["op12_divergence"](spark, sf).where("part = 'term'").count() == 0
    got = QUERIES["op13_infill"](spark, sf).collect()
    assert sorted(r["restored_sha256"] for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in AWKWARD)
