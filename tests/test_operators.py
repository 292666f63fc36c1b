"""The operators on many files at once, the data source and the streams."""

import json
import time

import pyarrow as pa  # noqa: F401
import pytest
from pyspark.sql import functions as F

from folio.cos.document import open_document
from folio.functions import geometry as G
from folio.functions import ranges as R
from folio.operators import files as ops
from folio.plans import closure, selection, tree
from folio.sources import pdf
from folio.streaming import ingest
from tests import fixtures as X


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", X.pages(11)), ("b", X.object_streams(3)), ("locked", X.encrypted("aes128", b"user")), ("junk", b"no file"), ("cut", X.pages(4)[:-400]), ("none", None), ("lie", X.pages(3, count=2))]
    return spark.createDataFrame(rows, "doc_id string, content binary").repartition(3)


def test_counts_and_errors(files):
    got = {r.doc_id: r for r in ops.page_count(files, strict=True).collect()}
    assert {k: r.pages for k, r in got.items()} == {"a": 11, "b": 3, "locked": None, "junk": None, "cut": 4, "none": None, "lie": 3}
    assert got["locked"].error.code == "password" and "damaged" in got["junk"].error.message
    assert {r.doc_id: r.pages for r in ops.page_count(files).collect()}["lie"] == 2
    with pytest.raises(Exception, match="password"):
        ops.page_count(files, mode="strict").collect()
    assert ops.page_count(files.where("doc_id = 'locked'"), password="user").first().pages == 3
    assert ops.page_count(files.limit(0)).count() == 0


def test_tables(files):
    t = pdf.load(files)
    pages = tree.pages(t)
    counts = {r.doc_id: (r.fast, r.strict) for r in tree.page_counts(t, pages).collect()}
    assert counts == {"a": (11, 11), "b": (3, 3), "cut": (4, 4), "lie": (2, 3)}
    assert [r.doc_id for r in tree.suspicious(tree.page_counts(t, pages)).collect()] == ["lie"]
    order = [r.obj for r in pages.where("doc_id = 'a'").orderBy("page_no").collect()]
    assert order == open_document(X.pages(11)).pages()
    docs = {r.doc_id: r for r in t["documents"].collect()}
    assert docs["cut"].repaired and docs["cut"].load_path == "repair" and docs["junk"].error.code == "pdf"
    assert tree.orphan_members(t["xref"]).count() == 0
    assert {r.kind for r in tree.latest_wins(t["xref"]).where("doc_id = 'b'").collect()} == {"plain", "member"}
    j = {r.doc_id: r.json for r in tree.dimensions_json(tree.page_geometry(pages)).collect()}
    assert json.loads(j["b"]) == {"pages": 3, "page_sizes": [{"width": 612, "height": 792, "rotation": 0}] * 3}


def test_tree_guards(spark):
    b = X.pages(3)
    kids = open_document(b).get(2)["Kids"]
    two = open_document(b).get(2)
    rows = [("twice", X.updated(b, {2: two | {X.N("Kids"): [*kids, kids[0]]}})), ("loop", X.updated(b, {2: two | {X.N("Kids"): [X.Ref(2, 0)]}})), ("direct", X.updated(b, {2: two | {X.N("Kids"): [{}]}})), ("good", b)]
    t = pdf.load(spark.createDataFrame(rows, "doc_id string, content binary"))
    errors = {r.doc_id: r.message for r in tree.tree_errors(t, tree.walk(t)).collect()}
    assert "cycle" in errors["twice"] and "cycle" in errors["loop"] and "direct" in errors["direct"] and "good" not in errors
    assert {r.doc_id for r in tree.pages(t).collect()} == {"good"}


def test_split_and_merge(spark, files):
    want = spark.createDataFrame([("a", "x.pdf", "z,1"), ("a", "y.pdf", "2-4"), ("b", "z.pdf", "9")], "doc_id string, path string, spec string")
    got = {r.path or r.doc_id: r for r in ops.split(files, want).collect()}
    assert len(open_document(got["x.pdf"].content).pages()) == 2 and len(open_document(got["y.pdf"].content).pages()) == 3
    assert got["b"].error.code == "range"
    parts = ops.split_pages(files.where("doc_id = 'a'"), "p%d.pdf", 4).collect()
    assert sorted((r.path, len(open_document(r.content).pages())) for r in parts) == [("p1.pdf", 4), ("p2.pdf", 4), ("p3.pdf", 3)]
    inputs = spark.createDataFrame([("m", 0, "a", "2;1"), ("m", 1, "cut", None), ("m", 2, "b", "1-z"), ("bad", 0, "nowhere", None)], "output string, input_ord int, doc_id string, spec string")
    m = {r.output: r for r in ops.merge(files, inputs).collect()}
    assert len(open_document(m["m"].content).pages()) == 2 + 4 + 3 and m["bad"].error.code == "io"
    texts = ops.extract_text(spark.createDataFrame([("m", m["m"].content)], "doc_id string, content binary"), pages="1,2,1").collect()
    assert [[x.text for x in r.runs] for r in sorted(texts, key=lambda r: r.page)] == [["page 2"], ["page 1"]]


def test_dimensions_and_drawing(files):
    d = ops.page_dimensions(files.where("doc_id = 'b'")).collect()
    assert [(r.page_no, r.width, r.height, r.rotation) for r in d] == [(k, 612.0, 792.0, 0) for k in (1, 2, 3)]
    r = ops.render_pages(files.where("doc_id in ('b', 'locked')"), dpi=36.0, pages="r1").collect()
    by = {x.doc_id: x for x in r}
    assert (by["b"].page, by["b"].width_px, by["b"].height_px, by["b"].name_no) == (3, 306, 396, "3") and by["b"].png[:4] == b"\x89PNG"
    assert by["locked"].error.code == "unsupported"


def test_range_columns(spark):
    specs = ["1-3", " z , r2,1", "5-2", "1;2", "", "1,,2", "0", "r9", "1-2-3", "+2", "z-1", "r1-r3", "1 - z"]
    rows = spark.createDataFrame([(s, n) for s in specs for n in (0, 1, 5)], "spec string, n int").select("spec", "n", R.resolve("spec", "n").alias("p"), R.resolve_error("spec", "n").alias("e")).collect()
    for r in rows:
        try:
            want = R.pages_of(r.spec, r.n)
        except R.FolioError:
            assert r.p is None and r.e, r
        else:
            assert list(r.p) == want and r.e is None, r


def test_number_columns(spark):
    vals = [612.0, 1.0004999, 2.5, -1.25, 0.0, float("nan"), float("inf"), 1234.5678]
    from folio.cos.text import json_number

    d = spark.createDataFrame([(v,) for v in vals], "v double").select("v", G.json_number(F.col("v")).alias("j")).collect()
    assert [r.j for r in d] == [json_number(v) for v in vals]
    s = spark.createDataFrame([('a"\\\n\x01',)], "s string").select(G.json_string(F.col("s")).alias("j")).first().j
    assert s == '"a\\"\\\\\\n\\u0001"'
    px = spark.range(1).select(G.pixels(F.lit(612.0), 150).alias("w"), G.pixels(F.lit(792.0), 150).alias("h")).first()
    assert (px.w, px.h) == (1275, 1649)


def test_closure(spark, files):
    t = pdf.load(files.where("doc_id = 'a'"))
    pages = tree.pages(t)
    refs = closure.page_refs(t["refs"], t["objects"])
    starts = pages.select(F.col("page_no").alias("output"), "doc_id", "obj")
    c = closure.closure(starts, refs)
    sizes = {r.output: r.n for r in c.groupBy("output").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {3}  # the page, its content, the font
    n = closure.renumber(closure.with_values(c, t["objects"]))
    assert {tuple(sorted(r.x)) for r in n.groupBy("output").agg(F.collect_list("new_obj").alias("x")).collect()} == {(1, 2, 3)}
    rw = closure.rewritten_refs(n, t["refs"])
    assert rw.where("key_path = '/Parent' and new_dst is null").count() == 11
    assert closure.structure_refs(t["refs"], t["objects"], c.select("doc_id", "obj").distinct()).count() > 0
    shared = closure.shared(c.select(F.col("output").alias("page"), "obj"), starts.select(F.col("output").alias("page")))
    assert [r.obj for r in shared.collect()] == [3]


def test_selection(spark):
    c = spark.createDataFrame([("a", 12), ("b", 0)], "doc_id string, n bigint")
    assert [r.name_no for r in selection.chunks(c, 5).orderBy("chunk").collect()] == ["1", "2", "3"]
    assert [r.name_no for r in selection.chunks(c, 1).orderBy("chunk").collect()][:2] == ["01", "02"]
    with pytest.raises(ValueError):
        selection.chunks(c, 0)
    with pytest.raises(ValueError):
        selection.output_path("x", F.lit("1"))
    specs = spark.createDataFrame([("o", "a", "1-z"), ("p", "a", "z-2"), ("q", "a", "1-3")], "output string, doc_id string, spec string")
    assert {r.output: r.prune for r in selection.prune_decision("split", specs, c).collect()} == {"o": False, "p": True, "q": True}
    assert selection.selection_errors(specs.union(spark.createDataFrame([("r", "a", "13"), ("s", "zz", "1")], specs.schema)), c).count() == 2


def test_data_source(spark, tmp_path):
    pdf.register(spark)
    rows = [("d/one.pdf", X.pages(2)), ("two.pdf", X.pages(3))]
    spark.createDataFrame(rows, "path string, content binary").write.format("folio").mode("append").save(str(tmp_path))
    assert (tmp_path / "d/one.pdf").read_bytes() == rows[0][1] and not list(tmp_path.rglob("*.part"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = spark.read.format("folio").load(str(tmp_path))
        assert sorted(r.declared for r in d.where("rec = 'doc'").collect()) == [2, 3]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    by_spark = ops.page_count(pdf.read_files(spark, str(tmp_path)))
    assert sorted(r.pages for r in by_spark.collect()) == [2, 3]


def test_streams(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "a.pdf").write_bytes(X.pages(2))
    files = ingest.arriving(spark, str(src))
    q = ingest.write_geometry(files, str(out), str(cp))
    try:
        q.processAllAvailable()
        time.sleep(0.1)
        (src / "b.pdf").write_bytes(X.pages(3))
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(str(out))
    assert sorted(r["count"] for r in got.groupBy("doc_id").count().collect()) == [2, 3]
    (src / "c.pdf").write_bytes(X.pages(3))  # delivered again under another name
    q = ingest.page_counts(ingest.once(ingest.arriving(spark, str(src)))).writeStream.format("memory").queryName("counted").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.pages for r in spark.table("counted").collect()) == [2, 3]
    q = ingest.arrivals(ingest.arriving(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(r.files for r in spark.table("arrived").collect()) == 3


def test_doubled_trees_end(spark):
    """Forty nodes that list their only kid twice; and a node that only an unused branch lists again."""
    N, R = X.N, X.Ref
    o = {1: {N("Type"): N("Catalog"), N("Pages"): R(2, 0)}}
    o |= {k: {N("Type"): N("Pages"), N("Kids"): [R(k + 1, 0)] * 2, N("Count"): 1} for k in range(2, 42)} | {42: {N("Type"): N("Page")}}
    unused = X.updated(X.pages(3), {90: {N("Type"): N("Pages"), N("Kids"): [R(open_document(X.pages(3)).pages()[0], 0)]}})
    t = pdf.load(spark.createDataFrame([("bomb", X.write.file(o, R(1, 0))), ("unused", unused)], "doc_id string, content binary"))
    w = tree.walk(t)
    assert {r.doc_id: r.message for r in tree.tree_errors(t, w).collect()} == {"bomb": "page tree cycle detected at object 10"}
    assert tree.pages(t, w).where("doc_id = 'unused'").count() == 3 and w.count() < 100


def test_closures_are_whole_or_an_error(spark):
    refs = spark.createDataFrame([("d", k, k + 1) for k in range(40)], "doc_id string, src_obj long, dst_obj long")
    starts = spark.createDataFrame([("o", "d", 0)], "output string, doc_id string, obj long")
    assert closure.closure(starts, refs).count() == 41
    with pytest.raises(Exception, match="deeper than 10"):
        closure.closure(starts, refs, most=10)


def test_page_values_come_with_the_text(spark, files):
    """A page's dictionary, as the tables have it, from the parse that reads its text."""
    t = pdf.load(files)
    want = {(r.doc_id, r.page_no): r.value for r in tree.pages(t).join(t["objects"].select("doc_id", "obj", "value"), ["doc_id", "obj"]).collect()}
    got = ops.extract_text(files, values=True).collect()
    assert {(r.doc_id, r.page): r.value for r in got if r.error is None} == want
    assert {r.doc_id: r.value for r in got if r.error is not None} == {"locked": None, "junk": None, "none": None}


def test_pruned_forms_joins_nothing(spark):
    """Tables of files look small by their bytes; a join of them would be broadcast through the driver."""
    from folio import roundtrips

    plan = roundtrips.pruned_forms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_owner_opens_without_a_cipher_in_python(monkeypatch):
    """A file with a user's password: refused without one, opened with the owner's, in no block of AES worked out here."""
    from folio.cos import crypt
    from folio.cos.objects import FolioError
    from folio.operators import synth

    if crypt.LIBRARY is None:
        pytest.skip("hashlib has no OpenSSL here")
    for f in ("_encrypt_block", "_decrypt_block", "plain_rc4"):
        monkeypatch.setattr(crypt, f, None, raising=False)
    for kind in ("rc4", "aes128", "aes256"):
        data = synth.build([{"text": "one"}, {"text": "two"}], title="7", seal=crypt.Sealer(kind, b"7", b"owner", b"7"))
        with pytest.raises(FolioError, match="requires a password"):
            pdf.read_document(data, lambda d: d.count(False), None, "7")
        assert [pdf.read_document(data, lambda d: d.count(False), p, "7") for p in ("owner", "7")] == [2, 2]
