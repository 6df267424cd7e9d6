import random
import subprocess
import sys


from paperloom.operators import alto, mining, quality, scripts
from paperloom.operators.scripts import edit_script

BIG = 2**53 + 1


def full_table(src, dst):
    n, m = len(src), len(dst)
    cost = [[i + j for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (src[i - 1] != dst[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (src[i - 1] != dst[j - 1]):
            i, j = i - 1, j - 1
            if src[i] != dst[j]:
                out.append(("replace", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


def test_scripts_equal_the_full_table():
    rng = random.Random(1)
    for _ in range(3000):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        src = [rng.choice(letters) for _ in range(rng.randrange(14))]
        dst = [rng.choice(letters) for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in src if rng.random() < 0.8] + list("b" * rng.randrange(3))
        assert edit_script(src, dst) == full_table(src, dst)
    assert edit_script([], []) == [] and edit_script(list("abc"), []) == full_table("abc", "") and edit_script([], list("ab")) == full_table("", "ab")


def test_long_lines_take_little_memory():
    code = """
import random, resource
from paperloom.operators.scripts import edit_script
rng = random.Random(2)
a = [f"w{rng.randrange(5000)}" for _ in range(20000)]
b = [x for x in a if rng.random() < 0.9]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(edit_script(a, b)) == len(a) - len(b)
c = [rng.choice(a) for _ in a]
edit_script(a, c)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout) < 100


PAIRS = "pair_id long, raw_text string, gold_text string, fixed_text string"


def pairs():
    rng = random.Random(5)
    rows = [(BIG, "a b c", "a b d", "a x d"), (None, "a b", None, "a"), (BIG, None, "x", None), (7, "", "", ""), (8, "one two three four", "one three four five", "zero one two four"), (7, "a a b", "a b", "a")]
    words = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randrange(9)))
    return rows + [(100 + k, words(), words(), words()) for k in range(60)]


def plain(raw, gold, fixed):
    raw, gold, fixed = ((t or "").split() for t in (raw, gold, fixed))
    name = lambda s, d: {(t, i, "" if t == "insert" else s[i], "" if t == "delete" else d[j]) for t, i, j in full_table(s, d)}
    right, done = name(raw, gold), name(raw, fixed)
    hit = len(right & done)
    from difflib import SequenceMatcher

    clean = [i for tag, i1, i2, _, _ in SequenceMatcher(None, raw, gold, autojunk=False).get_opcodes() if tag == "equal" for i in range(i1, i2)]
    now = {}
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, raw, fixed, autojunk=False).get_opcodes():
        if tag != "delete":
            now |= dict(zip(range(i1, i2), fixed[j1:j2], strict=False))
    bad = sum(now.get(i) != raw[i] for i in clean)
    distance = lambda a: len(full_table(a, gold)) / len(gold) if gold else 0.0
    return (hit / len(done) if done else 1.0, hit / len(right) if right else 1.0, bad / len(clean) if clean else 0.0, bad, len(clean)), (distance(raw), distance(fixed))


def test_whole_record_with_inserts_and_deletes(spark):
    rows = pairs()
    table = spark.createDataFrame(rows, PAIRS).repartition(3)
    got = sorted(((r.pair_id, (r.edit_precision, r.edit_recall, r.damage_rate, r.damage_count, r.clean_token_count), (r.wer_raw, r.wer_fixed)) for r in quality.evaluate(table).collect()), key=repr)
    assert got == sorted(((r[0], *plain(*r[1:])) for r in rows), key=repr)
    scores = sorted(map(tuple, quality.edit_scores(table).collect()), key=repr)
    assert scores == sorted(((k, *m[:2]) for k, m, _ in got), key=repr)
    assert sorted(map(tuple, quality.damage(table).collect()), key=repr) == sorted(((k, *m[2:]) for k, m, _ in got), key=repr)


def test_alignment_by_automaton_is_the_usual_one(monkeypatch):
    from difflib import SequenceMatcher

    monkeypatch.setattr(scripts.Aligner, "CROWDED", 0)
    rng = random.Random(6)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a = [rng.choice(letters) for _ in range(rng.randrange(40))]
        b = [rng.choice(letters) for _ in range(rng.randrange(40))] if rng.random() < 0.4 else [rng.choice(letters) if rng.random() < 0.2 else x for x in a if rng.random() < 0.9]
        assert scripts.opcodes_of(a, b) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_opcodes_have_places_and_keys(spark):
    from difflib import SequenceMatcher

    rows = [r for r in pairs() if r[1] is not None and r[2] is not None]
    got = mining.opcodes(spark.createDataFrame(rows, PAIRS)).collect()
    want = [(k, *op, a.split()[op[1] : op[2]], b.split()[op[3] : op[4]]) for k, a, b, _ in rows for op in SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.tag for r in got} == {"equal", "replace", "insert", "delete"}
    assert mining.opcodes(spark.createDataFrame([], PAIRS)).collect() == []


def test_pages_keep_their_keys(spark):
    page = lambda v, more="": f'<?xml version="1.0" encoding="ISO-8859-1"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v{v}#"><Layout>{more}<TextBlock ID="é" HPOS="3"><TextLine VPOS="2"><String CONTENT="a"/><SP/><HYP/></TextLine><TextLine/><x><TextLine><String CONTENT="no"/></TextLine></x></TextBlock></Layout></alto>'
    nested = '<TextBlock ID="out"><TextBlock ID="in"><TextLine><String CONTENT="i"/></TextLine></TextBlock><TextLine><String CONTENT="o"/></TextLine></TextBlock>'
    rows = [(BIG, page(2)), (None, page(4, nested)), (BIG + 2, "<broken"), (5, None), (6, "<a/>"), (7, page(2)[:-3])]
    out = alto.parse_pages(spark.createDataFrame(rows, "k long, xml string").coalesce(1)).collect()
    assert [(r.k, r.block_idx, r.bad_xml, r.id) for r in out] == [(BIG, 0, False, "é"), (None, 0, False, "out"), (None, 1, False, "in"), (None, 2, False, "é"), (BIG + 2, None, True, None), (5, None, True, None), (7, None, True, None)]
    assert [x.text for x in out[0].lines] == ["a -", ""] and [x.text for x in out[1].lines] == ["o"]


def test_large_pages_are_parsed_in_pieces():
    line = '<TextLine VPOS="1"><String CONTENT="word"/><SP/><String CONTENT="other"/></TextLine>'
    code = f"""
import resource
from paperloom.operators.alto import page_blocks
page = ('<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#">' + ('<TextBlock ID="b">' + {line!r} * 20 + '<Shape>' + '<p/>' * 20000 + '</Shape></TextBlock>') * 600 + '</alto>').encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(page_blocks(page)) == 600 and len(page) > 45e6
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout) < 40
