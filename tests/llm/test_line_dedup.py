import hashlib
from collections import defaultdict

from evenkeel.llm.line_dedup import LineRuns, line_dedup
from evenkeel.llm.queries import op1_line_dedup, read

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """rows: (id, text) -> sorted list of (id, n_lines, n_dropped, text)."""
    order = lambda i: -(2**63) if i is None else i
    held = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_edge_cases(odd):
    for batches in (1, 3):
        got = [tuple(r) for r in line_dedup(odd, batches=batches, fanout=2).select("doc_id", "n_lines", "n_dropped", "text").collect()]
        assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_a_dozen_batches(spark):
    """Runs are compacted over several levels, and each line is kept where its smallest document lies."""
    rows = [(i, "\n".join(f"a line of number {j}" for j in (i * i % 17, i % 5, i))) for i in range(60)]
    found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=12, fanout=3)
    got = [tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(none):
    assert line_dedup(none).collect() == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    want = sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(docs))
    assert sorted(map(tuple, op1_line_dedup(spark, sf).collect())) == want


def test_runs_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for i in range(5):
        keys = spark.createDataFrame([(k, 0, i) for k in (i, i + 1)], "h long, g int, keeper long")
        new = runs.unseen(keys)
        if runs.runs():  # the batch is dealt once, the runs lie where they are
            plan = new._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        runs.add(new)
    assert sorted(tuple(r) for r in runs.all().collect()) == [(k, 0, max(0, k - 1)) for k in range(6)]
    assert [len(x) for x in runs.levels] == [1, 0, 1]


def test_common_and_very_long(spark):
    docs = spark.range(1500).selectExpr("id doc_id", "concat('line number ', id, '\n a line that all share\ntail') text")
    long = spark.range(2).selectExpr("id + 2000 doc_id", "repeat(concat('a line that all share\nunique line ', id, ' of many\n'), 500000) text")
    both = line_dedup(docs.unionByName(long))
    rows = both.filter("doc_id < 2000").selectExpr("sum(n_dropped) n", "max(length(text)) m").first()
    assert (rows.n, both.filter("doc_id = 0").first().n_dropped) == (1499, 0)
    big = both.filter("doc_id >= 2000").selectExpr("n_lines", "n_dropped").collect()
    assert [tuple(r) for r in big] == [(1_000_001, 500_000)] * 2
