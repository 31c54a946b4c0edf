"""Default word tables for text normalisation.

Fixed values.  These are this library's own small English defaults, passed to
``normalise_text`` as DataFrames; callers with a real stop list or lemma
dictionary pass their own tables instead (any size: they are joined, broadcast
only when small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: English stop words (lower case) ---
STOP_WORDS = """
a about above after again against all almost also am among an and any are as at
be because been before being below between both but by can cannot could did do
does doing done down during each either else ever every few for from further get
got had has have having he her here hers herself him himself his how however i
if in into is it its itself just least less let like many may me might more most
much must my myself neither no nor not now of off often on once only or other
our ours ourselves out over own per perhaps quite rather really same see seem
seemed seems several shall she should since so some still such than that the
their theirs them themselves then there these they this those though through thus
to too under until up upon us very was we well were what whatever when where
whether which while who whom whose why will with within without would yet you
your yours yourself yourselves
""".split()

# --- fixed values: number words (cardinals and scale words, lower case) ---
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen
fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty
sixty seventy eighty ninety hundred thousand million billion trillion
""".split()

# --- fixed values: irregular English forms and their lemma ---
LEMMA_PAIRS = [
    ("ate", "eat"), ("became", "become"), ("began", "begin"), ("begun", "begin"),
    ("better", "good"), ("best", "good"), ("bought", "buy"), ("brought", "bring"),
    ("came", "come"), ("children", "child"), ("chose", "choose"), ("chosen", "choose"),
    ("felt", "feel"), ("found", "find"), ("gave", "give"), ("given", "give"),
    ("gone", "go"), ("went", "go"), ("goes", "go"), ("heard", "hear"), ("held", "hold"),
    ("kept", "keep"), ("knew", "know"), ("known", "know"), ("left", "leave"),
    ("lost", "lose"), ("made", "make"), ("meant", "mean"), ("men", "man"),
    ("met", "meet"), ("paid", "pay"), ("people", "person"), ("ran", "run"),
    ("said", "say"), ("saw", "see"), ("seen", "see"), ("sent", "send"),
    ("spoke", "speak"), ("spoken", "speak"), ("stood", "stand"), ("taken", "take"),
    ("took", "take"), ("taught", "teach"), ("thought", "think"), ("told", "tell"),
    ("understood", "understand"), ("wanted", "want"), ("women", "woman"),
    ("won", "win"), ("wrote", "write"), ("written", "write"), ("worse", "bad"),
    ("worst", "bad"), ("feet", "foot"), ("teeth", "tooth"), ("mice", "mouse"),
]


def stopword_table(spark: SparkSession, words: list[str] | None = None) -> DataFrame:
    """One-column table ``form`` of words to drop (stop words + number words)."""
    words = sorted(set(STOP_WORDS) | set(NUMBER_WORDS)) if words is None else sorted(set(words))
    return spark.createDataFrame([(w,) for w in words], "form string")


def lemma_table(spark: SparkSession, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Two-column table ``(form, lemma)``; forms are lower case."""
    pairs = LEMMA_PAIRS if pairs is None else pairs
    return spark.createDataFrame(pairs, "form string, lemma string")
