"""Masked sources and data flow, with edges worked out by hand."""

import tracemalloc

import pyarrow as pa
import pytest
from tessera import queries as core
from tessera.functions import code, text

SOURCE = """import x from 'a(b)'  // call(me)
const base = '/api', limit = 3
/* load(base) */
export function load(path, depth) {
  let size = depth
  const run = (item) => {
    send(item, size, path)
    size = 4
    send(size)
  }
  if (size) { log(`no ${path} load(base) ${wrap(depth)}`) }
  items.map(v => keep(v, base))
  return axios.get("/api/x", limit)
}
class Box {
  put(thing) { this.bus.emit('put', thing); base2(base, missing, 3, true) }
}
const r = /call\\(base\\)/.test(limit)
"""


def flow(text):
    return [(t, i, a, d) for t, _, _, _, i, a, d in code.flows(text) if i is not None]


def test_what_is_no_code_is_masked():
    m = code.masked(SOURCE)
    assert len(m) == len(SOURCE) and m.count("\n") == SOURCE.count("\n")
    assert "call(me)" not in m and "load(base)" not in m and "a(b)" not in m and "wrap(depth)" in m and "call\\(" not in m
    assert code.masked("a = 1 / 2 / f('x') // y") == "a = 1 / 2 / f(' ')     "
    assert code.masked("`a${`b${c}d`}e` + 'it\\'s'") == "` ${` ${c} `} ` + '     '"
    assert code.masked("'open\nx()") == "'    \nx()" and code.masked("/* open") == "       " and code.masked("") == ""


def test_calls():
    calls = [(t, q, n, x) for t, q, n, x, i, _, _ in code.flows(SOURCE) if i is None]
    assert calls == [
        ("send", "", 7, None), ("send", "", 9, None), ("log", "", 11, f"no ${{path}} load(base) ${{wrap(depth)}}"), ("wrap", "", 11, None), ("map", "items", 12, None), ("keep", "", 12, None),
        ("get", "axios", 13, "/api/x"), ("emit", "this.bus", 16, "put"), ("base2", "", 16, None), ("test", "", 18, None),
    ]


def test_definitions_reach_their_uses():
    assert flow(SOURCE) == [
        ("send", 0, "item", 6), ("send", 1, "size", 5), ("send", 2, "path", 4), ("send", 0, "size", 8), ("wrap", 0, "depth", 4), ("keep", 0, "v", 12), ("keep", 1, "base", 2),
        ("get", 1, "limit", None), ("emit", 1, "thing", 16), ("base2", 0, "base", 2), ("base2", 1, "missing", None), ("test", 0, "limit", None),
    ]


def test_scopes_and_shadows():
    text = "let a = 1\nfunction f(a) {\n  g(a);\n  { let a = 2\n    g(a) }\n  g(a)\n}\ng(a)\na += 2\ng(a)\n"
    assert flow(text) == [("g", 0, "a", 2), ("g", 0, "a", 4), ("g", 0, "a", 2), ("g", 0, "a", 1), ("g", 0, "a", 9)]
    assert flow("f(x, [y], y.z, -y, x)") == [("f", 0, "x", None), ("f", 4, "x", None)]
    assert flow("try { a() } catch (e) { report(e) }") == [("report", 0, "e", 1)]
    assert code.flows(None) == [] and code.flows("f(") != None  # noqa: E711


def test_kinds_of_edges(spark):
    rows = spark.createDataFrame([(1, "bus.emit('saved', doc)\nbus.on('saved', run)\nfetch(url)\naxios.post('/x')\nload('/api/y')\nplain(1)"), (2, None)], "id long, text string")
    got = [(r.kind, r.target, r.line, r.param_index) for r in code.edges(rows, "id", rows["text"]).collect()]
    assert got == [("emit", "saved", 1, None), ("data_flow", "emit", 1, 1), ("listen", "saved", 2, None), ("data_flow", "on", 2, 1), ("http_call", "fetch", 3, None), ("data_flow", "fetch", 3, 0), ("http_call", "post", 4, None), ("http_call", "load", 5, None), ("call", "plain", 6, None)]


@pytest.mark.parametrize("name", ["data_flow_edges", "source_structure", "code_compression", "json_chunks"])
def test_parts_of_one_file_are_many_tasks(spark, tmp_path, name):
    """Small rows in one file and row group: tasks go by their number."""
    rows = spark.range(40_000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS int) p_size", "'a' p_name", "'b' p_brand", "'c' p_type")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert core.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 2


def test_a_batch_is_python_objects_by_slices():
    """Texts of a whole batch are not held as Python objects at once."""
    pages = pa.array([f"<h1>p{i}</h1>" + "<p>word word</p>" * 80 for i in range(1200)])
    text.markdown_column.func(pages[:1])
    tracemalloc.start()
    md = text.markdown_column.func(pages)
    chunks = text.chunks_column.func(pa.array(["page.md"] * len(md)), md)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert md.to_pylist() == [text.html_to_markdown(x) for x in pages.to_pylist()] and len(chunks) == len(pages)
    assert peak < pages.nbytes / 2
    assert len(text.markdown_column.func(pages[:0])) == 0
