"""Rendering of LaTeX sources that hold headings alone, and of those that hold more."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import collapse
from folioscope.operators.paragraphs import blocks
from folioscope.sources import markup

CASES = [
    ("\\section{A}\nx \\% y \\_ z % gone\nw\\\\sectionx{b}", "\n\n§ A\n\nx % y _ z w\nsectionxb"),
    ("\\subsection*{B}\\section\\section{C} \\{d\\} \\sectionalpha $e$", "\n\n§.§ B\n\n\n§ C\n {d}  e"),
    ("\\begin{document}a\\end{document}b\\end{document}", "a"),
    ("a \\begin{document}\\section{\\alpha} b -- c", "\n\n§ α\n b – c"),
    ("\\alpha*x\\foo*y\\ z", "α*xy z"),
    ("\ue000 stays, \\$5", "% stays, $5"),
    ("", ""),
]


@pytest.mark.parametrize(("latex", "want"), CASES)
def test_rendered_sources(spark, latex, want):
    assert spark.createDataFrame([(latex,)], "latex string").select(markup.latex_text(F.col("latex"))).first()[0] == want


def test_macro_rules_run_on_sources_with_macros_only(spark, monkeypatch):
    monkeypatch.setattr(markup, "MACROS", [("word", "changed")])
    rows = spark.createDataFrame([("\\section{A} word",), ("\\emph{A} word",)], "latex string")
    assert [r[0] for r in rows.select(markup.latex_text(F.col("latex"))).collect()] == ["\n\n§ A\n word", "A changed"]


def test_nothing_behind_the_stop_section_is_collapsed(spark):
    rows = spark.createDataFrame([("one\n\n §  References \n\n two",), ("one\n\n§.§ Acknowledgements x\n\ntwo",), ("§\n\nreferences\n\ntwo",)], "text string")
    assert [r[0] for r in rows.select(blocks(F.col("text"))).collect()] == [["one"], ["one"], ["§", "references", "two"]]


@pytest.mark.parametrize("text", ["a b", " a  b ", "a\tb", "a \u00a0b", "a\n\u2003 \x1cb c", "", " "])
def test_runs_of_white_space_become_one_space(spark, text):
    assert spark.createDataFrame([(text,)], "text string").select(collapse(F.col("text"))).first()[0] == " ".join(text.split())
