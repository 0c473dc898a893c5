"""Markup's entities against html.unescape."""

import html
import re

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources import subtitles

TEXTS = ["a &lt;b&gt; &amp;lt; &quot;c&quot; &#39;", "<i>caf&eacute;</i>&nbsp;&#8217;s  &#x27;x&#X27;", "&nbsp; ends &nbsp;", "&notit; &copy 2 &unknown; & alone", "&#0; &#128; &amp;amp;eacute;", "none", "", None]


def test_all_entities_are_decoded_once(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").select("k", T.strip_markup(F.col("text")).alias("got")).collect()
    want = [None if t is None else html.unescape(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", t))).strip() for t in TEXTS]
    assert [r.got for r in sorted(rows, key=lambda r: r.k)] == want


def test_cues_have_decoded_text(spark):
    lines = spark.createDataFrame([("f", "1\n00:01.000 --> 00:02.000\nl&#8217;&eacute;t&eacute;\n")], "file string, content string")
    assert [r.text for r in subtitles.cues(lines).collect()] == ["l’été"]
