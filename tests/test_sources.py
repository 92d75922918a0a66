"""Reports, sidecars, traces and the streaming check."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberflow.functions.effects import BIT
from emberflow.sources import dependencies as D
from emberflow.sources import envelope as E
from emberflow.sources import locate as L
from emberflow.sources import report as R
from emberflow.sources import report as S
from emberflow.streaming.verify import violations


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_report_and_legacy_array(spark, tmp_path):
    fn = {"fn": "a.B.run", "inferred": ["Net"], "direct": [], "calls": ["a.C.go"], "entryPoint": True, "hash": "h"}
    paths = [write(tmp_path / "x.json", {"version": 1, "functions": [fn, {"loc": "no name"}]}), write(tmp_path / "y.json", [{"fn": "z"}])]
    rows = {r["fn"]: r for r in R.unit_key(R.read_functions(spark, paths)).collect()}
    assert set(rows) == {"a.B.run", "z"}
    assert rows["a.B.run"]["calls"] == ["a.C.go"] and rows["a.B.run"]["key"] == "h" and rows["z"]["inferred"] == [] and rows["z"]["key"] == "z"


@pytest.mark.parametrize("bad", [{"fn": "a", "inferred": "Net"}, {"fn": "a", "inferred": [1]}, {"fn": "a", "direct": None}, {"fn": "a", "entryPoint": "true"}, {"loc": "x"}])
def test_wrong_types_refuse(spark, tmp_path, bad):
    with pytest.raises(R.ReportRefused):
        R.read_functions(spark, [write(tmp_path / "x.json", {"functions": [bad]})]).count()


def test_broken_json_refuses(spark, tmp_path):
    with pytest.raises(R.ReportRefused):
        R.read_functions(spark, [write(tmp_path / "x.json", "{")])


def test_sidecars_round_trip(spark, tmp_path):
    p = write(tmp_path / "g.json", {"a": ["b", "c", "b"], "b": [], "@superclass": ["T", "S", "U", "T"]})
    pairs, nodes, partial = R.read_pairs(spark, [p])
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "c")] and nodes.count() == 2 and not partial
    assert sorted(map(tuple, R.read_superclasses(spark, [p]).collect())) == [("T", "S"), ("U", "T")]
    assert {r["source"]: json.loads(r["json"]) for r in R.pair_lines(pairs, nodes).collect()} == {"a": ["b", "c"], "b": []}
    assert R.read_pairs(spark, [p, write(tmp_path / "h.json", "{")])[2]


def test_report_lines_read_back(spark, tmp_path):
    p = write(tmp_path / "x.json", [{"fn": "a", "inferred": ["Fs"], "hosts": ["h"]}])
    f = R.read_functions(spark, [p])
    line = json.loads(R.report_lines(f).first()["json"])
    assert line["fn"] == "a" and line["hosts"] == ["h"] and "calls" not in line and line["direct"] == []
    again = R.read_functions(spark, [write(tmp_path / "y.json", [line])])
    assert again.drop("report").collect() == f.drop("report").collect()


def test_trace_counts_torn_lines(spark, tmp_path):
    rows, torn = R.read_trace(spark, write(tmp_path / "t.ndjson", '{"fn":"a","effect":"Net"}\n{"fn":"a"\n\n'))
    assert [tuple(r) for r in rows.collect()] == [("a", "Net")] and torn.first()["n"] == 1


def test_streaming_check(spark, tmp_path):
    rows = [("a", "Net", 1), ("a", "Net", 2), ("b", "Fs", 3), ("c", "Exec", 4)]
    src = spark.createDataFrame(rows, "fn string, effect string, s long").select("fn", "effect", F.timestamp_seconds("s").alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    f = spark.createDataFrame([("a", BIT["Fs"]), ("b", BIT["Unknown"])], "fn string, mask int")
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = violations(stream, f).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["fn"], r["effect"]) for r in spark.table("told").collect()) == [("a", "Net"), ("c", "Exec")]


def test_fnv1a(spark):
    from emberflow.sources.dependencies import FNV_FACTOR, FNV_START, fnv1a

    def plain(names):
        h = FNV_START
        for n in sorted(names):
            for b in n.encode() + b"\n":
                h = ((h ^ b) * FNV_FACTOR) % 2**64
        return f"{h:016x}"

    names = {"r1": ["b", "a", "ä.x", "a"], "r2": ["only"]}
    df = spark.createDataFrame([(r, n) for r, some in names.items() for n in some], "report string, name string").repartition(3)
    assert {r["report"]: (r["n"], r["digest"]) for r in fnv1a(df).collect()} == {r: (len(set(some)), plain(set(some))) for r, some in names.items()}


def test_locators(spark, tmp_path):
    from emberflow.sources import locate as L

    home = tmp_path / "proj" / ".reports"
    home.mkdir(parents=True)
    for n in ("report.a.json", "report.b.jvm.json", "report.a.callgraph.json", "report.json", "other.json", "report.x.encountered-1.json"):
        (home / n).write_text("{}")
    names = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    assert names(L.reports(spark, str(tmp_path / "proj"))) == ["report.a.json", "report.b.jvm.json", "report.json"]
    assert names(L.reports(spark, str(home / "report"), shape=".jvm.json")) == ["report.b.jvm.json", "report.json"]
    assert L.reports(spark, "any/where.json") == ["any/where.json"] and L.report(spark, str(tmp_path / "proj")).endswith("report.a.json")
    deep = tmp_path / "proj" / "src" / "x"
    deep.mkdir(parents=True)
    assert L.discover(spark, str(deep)) == str(home / "report") and L.discover(spark, str(deep), given="g") == "g"
    import pytest

    with pytest.raises(L.NotFound):
        L.report(spark, str(tmp_path / "none"))
    assert L.pair(spark, "a.json", "b.json") == ("a.json", "b.json")


def test_envelopes_and_whole_documents(spark, tmp_path):
    from emberflow.sources import dependencies as D
    from emberflow.sources import envelope as E
    from emberflow.sources import report as S

    doc = tmp_path / "report.a.json"
    doc.write_text('{"producer": {"version": "1", "toolchain": "t"}, "packages": ["p.q", "p.r"], "coverage": {"uncovered": [{"name": "x.y", "calls": 3}]}, "analyzed": {"count": 2, "digest": "d"}, "excluded": [{"class": "test", "count": 4, "peeked": true, "reason": "r"}], "scannedUnder": {"deny": ["deny Net"]}, "unanalyzed": [{"path": "a", "reason": "b"}], "functions": [{"fn": "p.A.f", "hash": "p/A.f()V", "inferred": ["Net", "Odd"], "unknownWhy": ["reflect:z"]}]}')
    bare = tmp_path / "report.b.json"
    bare.write_text('[{"fn": "p.B.g", "inferred": ["Fs"]}]')
    e = {r["report"].rsplit("/", 1)[1]: r for r in E.envelopes(spark, [str(doc), str(bare)]).collect()}
    a, b = e["report.a.json"], e["report.b.json"]
    assert (a["version"], a["packages"], a["n_analyzed"], a["uncovered"][0]["calls"], a["excluded"][0]["peeked"], a["switches"]) == ("1", ["p.q", "p.r"], 2, 3, True, None)
    assert b["version"] is None and b["packages"] is None
    assert [r["rule"] for r in E.unasked(E.envelopes(spark, [str(doc)]), ["deny Net", "pure x"]).collect()] == ["pure x"]
    whole = E.completeness(E.envelopes(spark, [str(doc), str(bare)])).first()
    assert whole["incomplete"] and whole["n_reports"] == 2 and len(whole["unanalyzed"]) == 1
    assert {r["what"] for r in E.unlike(E.envelopes(spark, [str(doc)]), E.envelopes(spark, [str(bare)])).collect()} == {"version", "toolchain"}
    assert E.label(["p.q", "p.r"]) == "p" and E.label(["a", "b"]) is None and E.label([]) is None
    (row,) = D.dependency_rows(spark, [str(doc)]).collect()
    from emberflow.functions.effects import mask_of

    assert row["mask"] == mask_of(["Net", "Unknown"]) and (row["hash"], row["version"], row["why"]) == ("p/A.f()V", "1", "reflect:z")
    d = {r["report"].rsplit("/", 1)[1]: r for r in D.doubts(spark, [str(doc), str(bare)]).collect()}
    assert d["report.a.json"]["incomplete"] and not d["report.a.json"]["empty"] and not d["report.b.json"]["incomplete"] and not d["report.b.json"]["empty"]
    assert D.dependency_paths(spark, str(tmp_path)) == [str(doc), str(bare)] == D.dependency_paths(spark, f"{doc}:{bare}")
    out = str(tmp_path / "out.json")
    rows = S.read_functions(spark, [str(doc), str(bare)])
    assert E.write_report(rows.repartition(3), out, {"head": {"version": "2"}, "packages": []}) and not E.write_report(rows, out, {"head": {"version": "2"}, "packages": []})
    assert {r["fn"] for r in S.read_functions(spark, [out]).collect()} == {"p.A.f", "p.B.g"} and E.envelopes(spark, [out]).first()["version"] == "2"
    assert E.write_report(rows.limit(0), str(tmp_path / "none.json"), {}) and (tmp_path / "none.json").read_text().replace("\n", "") == '{"functions": []}'
    types = tmp_path / "report.a.hierarchy.json"
    types.write_text('{"p.A": ["p.S"], "@superclass": ["p.A", "p.S"]}')
    assert [r["type"] for r in D.own_types(spark, [str(doc), str(bare)]).collect()] == ["p.A"]
    sw = spark.createDataFrame([("r1", ["B", "A"]), ("r2", []), ("r3", ["A", ""])], "report string, switches array<string>")
    assert [r["switch"] for r in E.switches(sw).collect()] == ["A", "B"]
    assert {r["report"]: r["switches"] for r in E.switched_dependencies(sw).collect()} == {"r1": ["A", "B"], "r3": ["A"]}


def test_streaming_and_batch_checks_agree(spark, tmp_path):
    from emberflow.functions.effects import mask_of
    from emberflow.operators.verbs import SCOPES, verify
    from emberflow.streaming.verify import violations

    functions = spark.createDataFrame([("a", mask_of(["Net"])), ("b", mask_of(["Fs"])), ("c", mask_of(["Unknown"]))], "fn string, mask int")
    seen = [("a", "Llm"), ("a", "Db"), ("a", "Fs"), ("b", "Db"), ("c", "Exec"), ("d", "Net"), ("d", "Net")]
    path = str(tmp_path / "seen")
    spark.createDataFrame([(f, e, "2024-01-01 00:00:00") for f, e in seen], "fn string, effect string, ts string").selectExpr("fn", "effect", "timestamp(ts) ts").write.parquet(path)
    stream = violations(spark.readStream.schema("fn string, effect string, ts timestamp").parquet(path), functions, SCOPES["all"])
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["fn"], r["effect"]) for r in spark.read.parquet(out).collect()}
    batch = verify(spark.read.parquet(path), functions, SCOPES["all"]).filter("verdict = 'violation'").collect()
    assert got == {(r["fn"], e) for r in batch for e in r["escaped"].split(",")} == {("a", "Fs"), ("b", "Db"), ("d", "Net")}


def test_call_graphs_are_paired_by_whole_paths(spark, tmp_path):
    """Paths with spaces, percent and plus signs, and reports whose paths end alike."""
    top = tmp_path / "p q%20+x"

    def put(path, names, count):
        path.parent.mkdir(parents=True, exist_ok=True)
        told = D.fnv1a(spark.createDataFrame([("x", n) for n in names], "report string, name string")).collect()
        path.write_text(json.dumps({"producer": {"version": "1"}, "analyzed": {"count": count, "digest": told[0]["digest"] if told else f"{D.FNV_START:016x}"}, "functions": []}))
        Path(L.sidecar(str(path), "callgraph")).write_text(json.dumps({n: [] for n in names}))
        return str(path)

    a, b = put(top / "p/report.a.json", ["m", "n"], 2), put(top / "z/p/report.a.json", ["m"], 2)
    c, d = put(top / "w x/report.\u00e9%b.json", ["k", "l", "o"], 3), put(top / "report.none.json", [], 0)
    got = [(r["report"], r["paired"], r["n"]) for r in D.paired_callgraphs(spark, [a, b, c, d, f"file://{a}"]).collect()]
    assert sorted(got) == sorted([(a, True, 2), (b, False, 1), (c, True, 3), (d, True, 0)])


def test_a_document_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "out s.json")
    lines = lambda to: S.pair_lines(spark.createDataFrame([("x", to)], "source string, target string"), spark.createDataFrame([("x",)], "source string"))
    assert E.write_pairs(lines("y"), path) and not E.write_pairs(lines("y"), path) and E.write_pairs(lines("z"), path)
    assert json.loads(Path(path).read_text()) == {"x": ["z"]} and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out s.json"]


def test_documents_in_lines_are_never_one_row(spark, tmp_path):
    """What is written here is read line by line; other layouts, and lines that are torn or out of place, are read whole."""
    fns = spark.createDataFrame([("a.A.x", ["Net"]), ("a.A.y", [])], "fn string, inferred array<string>")
    none = F.array().cast("array<string>")
    rows = fns.select("fn", F.lit("").alias("loc"), F.lit("").alias("hash"), F.lit("function").alias("unitKind"), *[F.lit(False).alias(k) for k in S.FLAGS], "inferred", *[none.alias(k) for k in S.LISTS if k != "inferred"])
    report, graph, bare = str(tmp_path / "r.json"), str(tmp_path / "r.callgraph.json"), str(tmp_path / "none.json")
    E.write_report(rows, report, {"packages": ["a"]})
    E.write_report(rows.limit(0), bare, {"packages": ["b"]})
    E.write_pairs(S.pair_lines(spark.createDataFrame([("s{,", "t}"), ("s{,", "t]")], "source string, target string"), spark.createDataFrame([("s{,",), ("q",)], "source string")), graph)
    assert S.in_lines(spark, [report, bare]) == ([report, bare], []) and S.in_lines(spark, [graph], sidecar=True) == ([graph], [])
    assert {r["json"][:14] for r in S.pieces(spark, [report]).collect()} == {'{"fn":"a.A.x",', '{"fn":"a.A.y",'}
    assert {(r["fn"], tuple(r["inferred"])) for r in S.read_functions(spark, [report]).collect()} == {("a.A.x", ("Net",)), ("a.A.y", ())}
    assert sorted(r["packages"][0] for r in E.envelopes(spark, [report, bare]).collect()) == ["a", "b"]
    other = write(tmp_path / "o.callgraph.json", {"q": ["u"]})
    pairs, names, partial = S.read_pairs(spark, [graph, other])
    assert sorted(map(tuple, pairs.collect())) == [("q", "u"), ("s{,", "t]"), ("s{,", "t}")] and {r[0] for r in names.collect()} == {"s{,", "q"} and not partial
    lines = Path(graph).read_text().splitlines()
    for bad in (lines[:-1], lines[::-1], lines[1:]):
        torn = write(tmp_path / "torn.callgraph.json", "\n".join(bad) + "\n")
        assert S.in_lines(spark, [torn], sidecar=True) == ([], [torn]) and S.read_pairs(spark, [torn])[2]
