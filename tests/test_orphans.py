from datetime import datetime

from trellis.operators.orphans import orphan_references, orphan_report

E = "src string, dst string, relation string, write_seq bigint, written_at timestamp_ntz"
P = "edge_id string, target_node string, first_seen_at string"
N = "id string, namespace string, seq bigint, written_at timestamp_ntz, removed_at timestamp_ntz, ref_table string"
T = datetime(2025, 3, 1)
LATE = datetime(2025, 5, 1)


def found(spark, edges, probes, nodes):
    got = orphan_references(spark.createDataFrame(edges, E), spark.createDataFrame(probes, P), spark.createDataFrame(nodes, N))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_each_reason_and_what_is_no_reference(spark):
    nodes = [("a", "nimbus", 1, T, None, "x"), ("b", "nimbus", 1, T, None, "x"), ("b", "nimbus", 2, LATE, LATE, "x"), ("late", "nimbus", 3, LATE, None, "x"), ("back", "nimbus", 4, T, T, "x"), ("back", "nimbus", 5, LATE, None, "x"), ("code::m", "code", 6, T, None, "x")]
    april = datetime(2025, 4, 2)
    edges = [
        ("s", " a\n", "links_to", 1, april), ("s", "b", "links_to", 2, april), ("s", "gone", "calls", 3, april), ("s", "late", "calls", 4, april), ("s", "late", "calls", 5, datetime(2025, 6, 1)), ("s", None, "calls", 6, april), ("s", "  ", "calls", 7, april),
        ("s", "a#Part", "LINKS_TO_SECTION", 8, april), ("s", "a^b1", "links_to_block", 9, april), ("s", "a#Part", "links_to", 10, april), ("s", "A", "calls", 11, april), ("s", "back", "calls", 12, april), ("s", "gone", "calls", 3, april), ("s", "a", "calls", 13, None),
    ]
    probes = [("p1", "nimbus::a", "2025-04-02T00:00:00Z"), ("p2", "code::m ", "2025-04-02T00:00:00+09:00"), ("p3", "nimbus::zz", "2025-05-01T00:30:00+01:00"), ("p4", None, "2025-04-02T00:00:00Z"), ("p5", "nimbus::zz", "no time")]
    want = [
        ("edges", "2", "2025-04", "removed"), ("edges", "3", "2025-04", "missing"), ("edges", "4", "2025-04", "later"), ("edges", "10", "2025-04", "missing"), ("edges", "11", "2025-04", "missing"),
        ("probe_state", "p3", "2025-04", "missing"), ("probe_state", "p5", None, "missing"),
    ]
    assert found(spark, edges, probes, nodes) == sorted(want, key=str)


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [("s", "a", "calls", 1, T)], [], []) == [("edges", "1", "2025-03", "missing")]


def test_report_counts(spark):
    edges = [("s", "a", "calls", 1, T), ("s", "x", "calls", 2, T), ("s", "x", "calls", 2, T)]
    got = orphan_report(spark.createDataFrame(edges, E), spark.createDataFrame([], P), spark.createDataFrame([("a", "nimbus", 1, T, None, "")], N)).collect()
    assert [(r["period"], r["refs"], r["orphans"], r["missing"]) for r in got] == [("2025-03", 2, 1, 1)]
