"""Model texts: declarations, statements, what is wrong with them, and the way back to text."""

from indexalg.nodes import canon
from indexalg.plans.render import jump, latex
from indexalg.plans.render.gams import model_lines
from indexalg.plans.render.text import show_model
from indexalg.sources.reader import SCHEMAS, clean_lines, decode, equation_header, expand_includes, read_model, read_model_files, read_models
from indexalg.sources.sample import SUPPLY
from indexalg.sources.sinks import text_lines, write_gams, write_latex, write_lines


def test_declarations():
    m = read_model("sets i, j /a,b,c/;\nset k /k1*k3/;\nscalar f 'rate' /3.5/, g /-1e3/;\nparameter d(i,j) 'dist' /a.b 1, b.c 2.5/;\ntable t(i,j) 'tab'\n     x   y\n a   1   2\n b       4\n;\nbinary variable z(i);\nalias (i, ip), (j, jp, jpp);")
    assert [(s.kind, s.name, s.dims, s.desc, s.vtype) for s in m.symbols] == [
        ("set", "i", [], None, None), ("set", "j", [], None, None), ("set", "k", [], None, None), ("parameter", "f", [], "rate", None), ("parameter", "g", [], None, None),
        ("parameter", "d", ["i", "j"], "dist", None), ("parameter", "t", ["i", "j"], "tab", None), ("variable", "z", ["i"], None, "binary"),
    ]
    assert m.symbols[2].data == [("k1",), ("k2",), ("k3",)] and m.symbols[3].data == [(3.5,)] and m.symbols[4].data == [(-1000.0,)]
    assert m.symbols[5].data == [("a", "b", 1.0), ("b", "c", 2.5)] and m.symbols[6].data == [("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 4.0)]
    assert m.aliases == [["i", "ip"], ["j", "jp", "jpp"]]


def test_strict_and_not():
    text = "equation e1; e1.. x =e= 1; e2(i)$c(i).. y(i) =g= 2;"
    assert read_model(text).diagnostics == [("e2", "body of an undeclared equation")]
    loose = read_model(text, strict=False)
    assert [(e.name, e.dims, e.domain) for e in loose.equations] == [("e1", [], None), ("e2", ["i"], "c(i)")]


def test_one_bad_equation_hinders_no_other():
    m = read_model("equation a, b, c; a.. x =n= 1; b.. x =e= (1; c.. x =e= 1;")
    assert [e.name for e in m.equations if e.node] == ["c"] and [d[0] for d in m.diagnostics] == ["a", "b"]
    assert read_model("equation a;").diagnostics == [("a", "declared without a body")]


def test_comments_blocks_includes():
    lines = ["* gone", " * kept", "$ontext", "gone", "$OFFTEXT", "kept", "$setglobal x", "$ontext", "to the end"]
    assert clean_lines(lines) == [" * kept", "kept"]
    files = {"a.inc": "x\n$include b.inc", "b.inc": "y"}
    assert expand_includes(["$include 'a.inc'", "$include none", "z"], files.get) == (["x", "$include b.inc", "z"], ["none"])
    assert expand_includes(["$Include a.inc"], files.get, 2) == (["x", "y"], [])
    m = read_model("$include s.inc\nparameter p(i);", include={"s.inc": "set i;"}.get)
    assert [s.name for s in m.symbols] == ["i", "p"]
    assert decode(b"a\xffb") == "a?b"


def test_headers():
    assert equation_header("e(r,y)$(m(r,y) and x$y)") == ("e", ["r", "y"], "(m(r,y) and x$y)")
    assert equation_header("e") == ("e", [], None) and equation_header("1e") is None


def test_written_model_reads_back():
    m = read_model(SUPPLY, "supply")
    for form in (True, False):
        again = read_model("\n".join(model_lines(m, form)))
        assert not again.diagnostics
        assert [(s.kind, s.name, s.dims, s.desc, s.vtype) for s in again.symbols] == [(s.kind, s.name, s.dims, s.desc, s.vtype) for s in sorted(m.symbols, key=lambda s: ["set", "mapping", "parameter", "variable"].index(s.kind))]
        assert [canon(e.node) for e in again.equations] == [canon(e.node) for e in m.equations]


def test_documents():
    m = read_model(SUPPLY, "supply", desc="a_sample", authors="some & others")
    text = latex.model_document(m)
    assert text.startswith("\\documentclass") and text.endswith("\\end{document}") and "a\\_sample" in text and "some \\& others" in text
    assert "\\section{Variables}" not in latex.model_document(m, ("sets",))
    assert latex.document(m.equation("eqCap"), standalone=False, aliases={"r": "n"}).startswith("\\begin{flushleft}")
    assert show_model(m).split("\n")[-6:] == ["Sets: 2", "Mappings: 1", "Aliases: 1", "Parameters: 2", "Variables: 2", "Equations: 3"]
    assert [jump.declaration(s) for s in m.of("variable")] == ["@variable(model, vFlow[r in r, y in y] >= 0)  # flow", "@variable(model, vTotal)  # total"]


def test_files(spark, tmp_path):
    m = read_model(SUPPLY, "supply")
    write_gams(m, str(tmp_path / "m.gms"))
    assert len(read_model((tmp_path / "m.gms").read_text()).equations) == 3
    write_latex(m, str(tmp_path / "m.tex"))
    write_latex(m.equation("eqCap"), str(tmp_path / "m.tex"), append=True)
    text = (tmp_path / "m.tex").read_text()
    assert text.count("\\documentclass") == 1 and text.count("\\textbf{eqCap}") == 2
    lines = text_lines(spark.createDataFrame([("a", SUPPLY), ("b", None)], "model_id string, text string"))
    write_lines(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/model_id=a")).collect()] == write_gams(read_model(SUPPLY, "a"))


def test_bulk_reading_equals_one_by_one(spark, tmp_path):
    rows = [("a", SUPPLY), ("b", "set i;"), ("c", None), ("d", "")]
    texts = spark.createDataFrame(rows, "model_id string, text string")
    for name in SCHEMAS:
        assert {r.model_id for r in read_models(texts, name).collect()} <= {"a", "b"}
    (tmp_path / "m.gms").write_bytes(b"set i a\xff;")
    got = read_model_files(spark, str(tmp_path)).collect()
    assert [(r.model_id, r.text) for r in got] == [("m.gms", "set i a?;")]
