import random

import pytest

from corvane.operators import chunking, diffs, quotas


def test_water_filling():
    fill = quotas.water_filled
    assert fill({"a": 100, "b": 100}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert fill({"a": 2, "b": 100, "c": 12}, {"a": 10, "b": 10, "c": 10}) == {"a": 2, "b": 16, "c": 12}
    assert fill({"a": 1, "b": 1}, {"a": 5, "b": 5}) == {"a": 1, "b": 1}
    assert fill({"a": 9, "b": 9, "c": 9}, {"a": 3, "b": 3, "c": 3}, 11) == {"a": 4, "b": 4, "c": 3}


def test_margins_are_met_where_cells_allow():
    draw = random.Random(4)
    for _ in range(300):
        rows, columns = [f"r{i}" for i in range(draw.randrange(1, 5))], [f"c{i}" for i in range(draw.randrange(1, 5))]
        there = {(r, c): draw.randrange(0, 6) for r in rows for c in columns}
        a, b = {r: draw.randrange(0, 8) for r in rows}, {c: draw.randrange(0, 8) for c in columns}
        flow = quotas.margins(there, a, b)
        assert all(0 <= n <= there[k] for k, n in flow.items())
        assert all(sum(flow[r, c] for c in columns) <= a[r] for r in rows) and all(sum(flow[r, c] for r in rows) <= b[c] for c in columns)
        # A greatest flow is as large as the least cut: for each choice of rows, what the others may give and what columns take of these.
        best = min(sum(a[r] for r in rows if r not in some) + sum(min(b[c], sum(there[r, c] for r in some)) for c in columns) for k in range(1 << len(rows)) for some in [{r for i, r in enumerate(rows) if k >> i & 1}])
        assert sum(flow.values()) == best


def test_samples_meet_their_quotas(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(120)], "id long, r string, c string")
    out, report = quotas.two_margins(rows, "r", "c", {"a": 10, "b": 5}, {"x": 5, "y": 4, "z": 6}, "id", "s")
    got = out.collect()
    assert len({x.id for x in got}) == 15 and [sum(x.r == r for x in got) for r in "ab"] == [10, 5] and [sum(x.c == c for x in got) for c in "xyz"] == [5, 4, 6]
    assert all(x.deficit == 0 for x in report.collect())
    _, report = quotas.two_margins(rows, "r", "c", {"a": 100, "b": 5}, {"x": 5, "y": 4, "z": 6}, "id", "s")
    assert {x.value: x.taken + x.deficit for x in report.collect()} == {"a": 100, "b": 5, "x": 5, "y": 4, "z": 6} and sum(x.taken for x in report.where("axis = 'c'").collect()) == 15


@pytest.mark.parametrize("target", [3, 9, 60])
def test_round_robin_as_one_queue_after_another(spark, target):
    import hashlib

    draw = random.Random(target)
    rows = [(i, "b" if i % 4 else "o", "k" + str(draw.randrange(3)), draw.randrange(25)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, bucket string, kind string, page int")
    got = {b: [r.id for r in sorted(x, key=lambda r: r.n)] for b in "bo" for x in [[r for r in quotas.round_robin(df, "bucket", "kind", "page", {"b": target, "o": target}, "id", "s").collect() if r.bucket == b]]}
    for b in "bo":
        mine = sorted([r for r in rows if r[1] == b], key=lambda r: (hashlib.md5(f"s{r[0]}".encode()).hexdigest(), r[0]))
        queues = [[r for r in mine if r[2] == k] for k in sorted({r[2] for r in mine})]
        seen, want, turn = set(), [], 0
        # A page met again in its own kind costs no turn: it is left out beforehand.
        queues = [[r for i, r in enumerate(q) if r[3] not in {x[3] for x in q[:i]}] for q in queues]
        while len(want) < target and any(queues):
            q = queues[turn % len(queues)]
            turn += 1
            if q and (r := q.pop(0))[3] not in seen:
                seen.add(r[3])
                want.append(r[0])
        assert got[b] == want


def test_changes_by_field(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (4, "d", 4)], "id long, s string, n int")
    new = spark.createDataFrame([(1, "a", 1), (2, "x", 2), (3, "c", None), (5, "e", 5)], "id long, s string, n int")
    diff = diffs.changes(old, new, "id", ["s", "n"])
    assert {r.id: (r.kind, r.fields) for r in diff.collect()} == {1: ("same", {}), 2: ("changed", {"s": "changed", "n": "set"}), 3: ("changed", {"n": "cleared"}), 4: ("removed", {}), 5: ("added", {})}
    assert {(r.field, r.how): r.n for r in diffs.field_counts(diff).collect()} == {(None, "same"): 1, (None, "changed"): 2, (None, "removed"): 1, (None, "added"): 1, ("s", "changed"): 1, ("n", "set"): 1, ("n", "cleared"): 1}


def test_reasons_of_long_chunks(spark):
    long = "word " * 400
    sections = [(1, 2, "b", None, None, long.replace(" ", "x")), (1, 1, "a", ["short one."], None, None), (1, 3, "c", [long, long], None, None), (2, 1, "d", None, [("n", long), ("m", long)], None), (2, 2, "e", None, None, None), (3, 1, "f", None, [(long, "")], None)]
    rows = spark.createDataFrame(sections, "doc_id long, no int, section string, chunks array<string>, list array<struct<name:string,desc:string>>, text string")
    trace = chunking.diagnosed(rows, 100).collect()
    got = {(r.doc_id, r.section, r.chunk): (r.payload, r.units, r.split, r.reason) for r in trace}
    assert got[1, "a", 0] == ("chunks_list", 1, False, "below_threshold")
    assert got[1, "b", 0] == ("text_blob", 1, False, "below_threshold")  # one word of 1,600 letters
    assert {v[3] for k, v in got.items() if k[1] == "c"} == {"merged_padding"} and {v[3] for k, v in got.items() if k[1] == "d"} == {"list_oversize_per_entry"}
    assert got[3, "f", 0] == ("list_entries", 1, False, "single_unit_oversize")
    assert [r.doc_chunk for r in sorted((r for r in trace if r.doc_id == 1), key=lambda r: r.doc_chunk)] == list(range(sum(r.doc_id == 1 for r in trace)))
    assert [r.section for r in sorted((r for r in trace if r.doc_id == 1), key=lambda r: r.doc_chunk)][0] == "a"
    total = chunking.long_tail(chunking.diagnosed(rows, 100), (100,)).where("payload is null and reason is null").first()
    assert total.chunks == len(trace) and total.over_100 == sum(r.tokens > 100 for r in trace)
