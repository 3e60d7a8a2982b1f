"""Fill-in-the-middle and the filter audit against brute force, and their defined cases."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from oddsmith.llm import audit, infill

CLASH = "n string, form string, digest string, mask string, good string, part string, smallest string, output string, unnamed string"
TEXTS = [
    None, "", " ", "word", "a1b2", "Ünïcödé ☃ 😀 straße\n\x0b", "has <P> in it", "has <S>", "has <M>", "<P", "ends with <S", "M>", "x" * 4000, "ab " * 30_000,
    "no words? 12 34\r\n", "\n\n", "Shouting LOUD words HERE", "money $ here", "plain words only " * 80, "plain words only " * 80, "same", "same", "it's odd ",
]


def table(spark, rows):
    extra = [None] * len(CLASH.split(","))
    return spark.createDataFrame([(i, t, s, *extra) for i, t, s in rows], f"doc_id long, text string, source string, {CLASH}")


def naive_units(text):
    found = []
    for c in text:
        letter = c.isascii() and c.isalpha()
        if found and letter and found[-1].isascii() and found[-1].isalpha():
            found[-1] += c
        else:
            found.append(c)
    return found


def naive_infill(doc_id, text):
    units = naive_units(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_brute_force(spark):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS * 6)] + [(None, "no id", "a"), (3, "twice", "a"), (3, "twice", "a")]
    got = infill.with_restored(infill.fill_in_middle(table(spark, rows))).collect()
    want = [(i, *naive_infill(i, t or ""), t or "") for i, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_of_nothing_and_all_plain(spark):
    none = table(spark, [])
    assert infill.with_restored(infill.fill_in_middle(none)).collect() == []
    got = infill.fill_in_middle(table(spark, [(1, "some text", "a")]), plain=100).collect()
    assert [(r["form"], r["output"]) for r in got] == [("plain", "some text")]


@given(st.text(alphabet="ab<PSM> é\n"), st.integers(0, 10**6))
def test_infill_round_trip(text, doc_id):
    n, form, prefix, middle, output = infill.transform(text, doc_id, plain=0)
    assert infill.restore(output, form) == text and (n, form, prefix, middle) == (*naive_infill_forced(text, doc_id),)


def naive_infill_forced(text, doc_id):
    units = naive_units(text)
    h = infill.digits(doc_id)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len("".join(units[:a])), len("".join(units[a:b]))


def test_infill_long_text_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 1000)
    rows = [(i, "w1 " * (i * 37 % 900), "a") for i in range(40)]
    got = infill.fill_in_middle(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *naive_infill(i, t)) for i, t, _ in rows)


# the filter audit


def naive_fails(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3


def naive_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, s in rows:
        copy = i is not None and first[t or ""] < i
        parts[s or ""].append((naive_fails(t or "") | copy << 4, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        removed_of, course = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                gone, alive = [d for d in alive if d[0] & bit], [d for d in alive if not d[0] & bit]
                failing = sum(1 for d in docs if d[0] & bit)
                removed_of[f] += len(gone)
                course["".join(order), step + 1] = (len(alive), len(gone), failing - len(gone), sum(1 for d in docs if d[0] == bit), sum(d[1] for d in gone), sum(d[2] for d in gone))
        out |= {(part, *k): (*v, removed_of[k[0][k[1] - 1]]) for k, v in course.items()}
    return out


def audited(spark, rows, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {tuple(r)[:3]: tuple(r)[3:] for r in audit.filter_audit(table(spark, rows), frame).collect()}


def test_audit_brute_force(spark):
    sources = ["a", "b", None, ""]
    rows = [(i, t, sources[i % 4]) for i, t in enumerate(TEXTS * 3)] + [(5, "same", "a"), (5, "same", "a"), (None, "same", "b"), (None, "only without id", "b"), (None, "only without id", "b"), (200, "only without id", "b")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(3, None, 1), (3, 1, None), (5, 1, 1), (None, 1, 1), (999, 1, 1)]
    got = audited(spark, rows, labels)
    assert got == naive_audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * 3


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert set(audited(spark, [(1, None, None)], [])) == set(itertools.product([""], map("".join, itertools.permutations("ABCDE")), range(1, 6)))


def test_audit_of_a_large_group_of_copies(spark):
    """A third of all rows are copies of one text in one part; none is gathered, each counts."""
    rows = [(i, "copy of a text with $", "hot") for i in range(2000)] + [(5000 + i, f"text number {i}", f"s{i % 3}") for i in range(4000)]
    got = audited(spark, rows, [(0, 1, 0), (1, 1, 1)])
    assert got["hot", "EABCD", 1] == (1, 1999, 0, 0, 1, 1, sum(got["hot", o, s][1] for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6) if o[s - 1] == "E"))


@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 4)), min_size=1))
def test_diagram_holds_its_counts_in_every_order(counts):
    diagram = audit.Diagram(counts)
    seen = {tuple(diagram.order)}
    for level in audit.adjacent_orders(5):
        diagram.swap(level)
        seen.add(tuple(diagram.order))
        assert diagram.weight(diagram.root, 0) == tuple(sum(c[k] for c in counts.values()) for k in range(3))
        alive = dict(counts)
        for v, kept, removed in diagram.steps():
            gone = [c for m, c in alive.items() if m >> v & 1]
            alive = {m: c for m, c in alive.items() if not m >> v & 1}
            assert removed == tuple(sum(c[k] for c in gone) for k in range(3)) and kept == tuple(sum(c[k] for c in alive.values()) for k in range(3))
    assert len(seen) == 120 and all(diagram.only(v) == counts.get(1 << v, (0, 0, 0)) for v in range(5))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_adjacent_orders_visit_each_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in audit.adjacent_orders(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))
