"""Nested groups, macros and tables of LaTeX."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources.groups import flattened
from folioscope.sources.markup import LATEX_SYMBOLS, latex_text

CASES = [
    (r"\section{On $\mathbb{Z}_{2}$ codes} text", "§ On Z_2 codes\n text"),
    (r"\newcommand{\code}{surface code}We study \code{} here.", "We study surface code here."),
    (r"\newcommand{\pair}[2]{(#1, #2)}\pair{a}{\textbf{b}} and \pair xy", "(a, b) and (x, y)"),
    (r"\newcommand{\by}[2][n]{#2 by #1}\by{m}, \by[k]{m}", "m by n, m by k"),
    (r"\def\twice#1{#1#1}\twice{\twice{a}}", "aaaa"),
    (r"\newcommand{\loop}{\loop x}\textbf{a {b}}", "a b"),
    (r"$\frac{a_{1}}{b}$ and $\frac{\frac{1}{2}}{c}$", "a_1/b and 1/2/c"),
    (r"\begin{tabular}{l|l}a & b \\ c & \textbf{d {e}}\end{tabular}", "a     b \n c     d e"),
    (r"{\large \section{A {B}} in a scope} after", "\n\n§ A B\n in a scope after"),
    (r"\emph{\cite[p.~1]{k} and \ref{x}, \alpha{}, 5\%, \{x\}}", "<cit.> and <ref>, α, 5%, {x}"),
    (r"\textbf{not {closed", "not closed"),
    (r"too many}} \emph{a {b}}", "too many a b"),
    ("\\emph{a % {\n{b}}", "a b"),
    ("", ""),
]


@pytest.mark.parametrize(("latex", "want"), CASES)
def test_sources_are_rendered(spark, latex, want):
    row = spark.createDataFrame([(latex,), (None,)], "latex string").select(latex_text(F.col("latex")))
    got = [r[0] for r in row.collect()]
    assert got[1] is None and got[0].strip() == want.strip()


def test_definitions_that_never_end_are_given_up():
    text = flattened(r"\newcommand{\a}{\a\a}\a{" + "x" * 10, LATEX_SYMBOLS)
    assert len(text) < 100_000
    deep = flattened("\\emph" + "{" * 500 + "x" + "}" * 500, LATEX_SYMBOLS)
    assert deep.count("x") == 1
