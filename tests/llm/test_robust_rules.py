"""The robust outlier verdict against the same estimates in NumPy, on every group."""

import re

import numpy as np
import pytest

from paperloom.llm import robust_rules as rules

FLOORS = np.array(rules.FLOORS, float)


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for p in range(len(words) - 7):
        seen.setdefault(tuple(words[p : p + 8]), []).append(p)
    again = {p + k for ps in seen.values() if len(ps) > 1 for p in ps for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols, upper = sum(c in "#*$%&|<>" for c in text), sum(c.isupper() for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), upper


def vector(n, chars, symbols, lines, again, upper):
    chars, words = max(chars, 1), max(n, 1)
    raw = [np.log(words), np.log(chars / words), np.log(1 + 1000 * symbols / chars), np.sqrt(upper / chars), np.sqrt(lines / words), np.sqrt(again / words)]
    return [int(np.floor(1000 * x + 0.5)) for x in raw]


def least_bin(values, share):
    values = np.sort(values)
    return values[int(np.ceil(share * len(values))) - 1]


def steps(away):
    return np.floor(50 * np.log1p(away)).astype(int)


def distance(x, mean, scatter):
    off = x - mean
    return np.maximum(np.einsum("ij,jk,ik->i", off, np.linalg.inv(scatter), off), 0)


def subset(x):
    mean = x.mean(0)
    return mean, (x.T @ x) / len(x) - np.outer(mean, mean) + np.diag(FLOORS**2)


def concentrated(x):
    grain = FLOORS // 8
    low, mid, high = (np.array([least_bin(np.floor(x[:, i] / grain[i]), share) for i in range(6)]) for share in (0.25, 0.5, 0.75))
    spread, mid = np.maximum((high - low) * grain / 1.349, FLOORS), (mid + 0.5) * grain
    u = (x - mid) / spread
    u = np.floor(1000 * u / np.sqrt((u**2).sum(1) + 1e-9)[:, None] + 0.5)
    signs = 6 * (u.T @ u) / len(x) / 1e6 * np.outer(spread, spread) + np.diag(FLOORS**2)
    best = None
    for mean, scatter in ((mid, np.diag(spread**2)), subset(x), (mid, signs)):
        state, log = None, np.inf
        while True:
            step = steps(distance(x, mean, scatter))
            own = x[step <= least_bin(step, rules.SHARE)]
            new_mean, new_scatter = subset(own)
            new = np.linalg.slogdet(new_scatter)[1]
            if state is not None and not new < log - rules.FALL:
                break
            state, log, mean, scatter = (len(own), new_mean, new_scatter), new, new_mean, new_scatter
        if best is None or log < best[0]:
            best = (log, *state)
    return best[1:]


def drawn(own, above):
    n, mean, scatter = own
    share = n / (n + rules.PRIOR)
    return n, share * mean + (1 - share) * above[1], share * scatter + (1 - share) * above[2]


def judged(rows):
    """(away, kept) of each (lang, source, text)."""
    stats = [statistics(t or "") for _, _, t in rows]
    ok = np.array([s[0] >= 20 and 100 * s[4] <= 30 * s[0] for s in stats])
    x = np.array([vector(*s) for s in stats], float)
    keys = [[(), (lang or "\x03",), (lang or "\x03", source or "\x03")] for lang, source, _ in rows]
    of = {}
    for k in np.flatnonzero(ok):
        for key in keys[k]:
            of.setdefault(key, []).append(k)
    raw = {key: concentrated(x[ks]) for key, ks in of.items()}
    fitted = {}
    for key in sorted(raw, key=len):
        fitted[key] = drawn(raw[key], fitted[key[:-1]]) if key else raw[key]
    away = np.full(len(rows), np.nan)
    for key, ks in of.items():
        if len(key) == 2:
            away[ks] = distance(x[ks], fitted[key][1], fitted[key][2])
    scale = {}
    for key in sorted(of, key=len):
        own = np.log((np.exp((least_bin(steps(away[of[key]]), 0.5) + 1) / 50) - 1) / rules.MEDIAN)
        n = len(of[key])
        scale[key] = (n * own + rules.PRIOR * scale[key[:-1]]) / (n + rules.PRIOR) if key else own
    for key, ks in of.items():
        if len(key) == 2:
            away[ks] /= max(1, np.exp(scale[key]))
    return away, np.nan_to_num(away, nan=np.inf) <= rules.CUTOFF


def junk(k):
    return " ".join(f"w{k}$$$ x{j}%%%&&&" for j in range(30 + k))


def prose(k):
    return " ".join(f"{'Some' if j % 9 == 0 else 'words'}{(j * 7 + k) % 23}" for j in range(40 + 3 * k)) + "."


def compare(spark, rows, few):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    limit, rules.BROADCAST_GROUPS = rules.BROADCAST_GROUPS, rules.BROADCAST_GROUPS if few else 0
    try:
        out = {r["doc"]["doc_id"]: r for r in rules.quality_rules(df, ["doc_id"]).collect()}
    finally:
        rules.BROADCAST_GROUPS = limit
    away, kept = judged(rows)
    assert len(out) == len(rows)
    for k in range(len(rows)):
        assert out[k]["kept"] == kept[k], (k, out[k], away[k])
        assert (out[k]["away"] is None) == np.isnan(away[k])
        if out[k]["away"] is not None:
            assert out[k]["away"] == pytest.approx(away[k], rel=1e-6, abs=1e-9)
    return kept


def test_verdicts_equal_numpy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    kept = compare(spark, rows, few=True)
    assert 20 < sum(~kept) < 300


@pytest.mark.parametrize("few", [True, False])
def test_small_groups_ties_and_nulls(spark, few):
    rows = [("en", "a", prose(k % 12)) for k in range(40)] + [("en", "b", prose(3))] * 5 + [("fr", "c", prose(2)), (None, None, prose(4)), (None, "a", prose(1))]
    rows += [("en", "a", junk(k)) for k in range(3)] + [("en", "alone", junk(9)), ("xx", "alone", junk(5)), (None, None, None), ("en", "a", ""), ("en", "a", "few words")]
    kept = compare(spark, rows, few)
    assert kept[:48].all() and not kept[48:].any()  # alone in its source or language, junk is judged all the same


def test_cutoff_is_the_quantile():
    assert rules.cutoff_at(0.001) == pytest.approx(22.458, abs=0.001)
    assert rules.cutoff_at(0.05) == pytest.approx(12.592, abs=0.001)


def test_nothing_usable(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, source string, text string, x0 long, g0 string, away int")
    assert rules.quality_rules(empty, empty.columns).count() == 0
    short = spark.createDataFrame([(1, "en", "a", "short", 5, "g", 7)], empty.schema)
    assert [tuple(r) for r in rules.quality_rules(short, short.columns, recount=True).select("doc.doc_id", "doc.away", "base_failed", "kept").collect()] == [(1, 7, True, False)]
