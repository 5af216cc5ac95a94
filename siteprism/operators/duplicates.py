"""Near-duplicate pages: an exact similarity join by prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteprism.common import materialize
from siteprism.functions import text as X


def shingles(pages: DataFrame, n: int = 3) -> DataFrame:
    """(site_id, page_seq, url, shingles): distinct hashes of n-word runs.

    Texts shorter than n words have one shingle of all their words.
    """
    w = F.col("_w")
    runs = F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(n)])
    )
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    some = pages.filter(F.col("text_content").rlike(f"(?s)(?!{X.WS})."))  # a word at least, without splitting twice
    words = some.select("site_id", "page_seq", "url", X.split_words(F.lower("text_content")).alias("_w"))
    return words.select("site_id", "page_seq", "url", F.array_distinct(F.when(F.size(w) >= n, runs).otherwise(short)).alias("shingles"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(site_id, rep, m): the earliest `first` of a page's pairs whose sets are similar enough, with the similarity."""
    left = sets.select("site_id", F.col("rep").alias("first"), F.col("shingles").alias("a"))
    both = F.size(F.array_intersect("a", "shingles"))
    checked = pairs.join(left, ["site_id", "first"]).join(sets, ["site_id", "rep"]).select(
        "site_id", "rep", "first", both.alias("both"), (F.size("a") + F.size("shingles") - both).alias("all")
    ).filter(100 * F.col("both") >= percent * F.col("all"))
    return checked.groupBy("site_id", "rep").agg(F.min(F.struct("first", (F.col("both") / F.col("all")).alias("similarity"))).alias("m"))


def near_duplicates(pages: DataFrame, percent: int = 80) -> DataFrame:
    """``near_duplicate_of``: the earliest earlier page of the site whose shingle sets' Jaccard similarity is high enough.

    Exact, by prefix and position filtering.  Pages with equal sets are one class.  Of two similar sets with o common
    shingles, the lead of each (all but its largest hashes) holds the o - m smallest of them, where m is what the longer
    lead leaves out.  So only leads, two fifths of the sets at 80 percent, are dealt by shingle.  With a lead's rarest
    shingles first, both share one of their first ``n - ceil(t * n) + 1``; shingles of a single class are the rarest and
    can't be shared, so they only take up places.  Navigation and other boilerplate is frequent and falls behind the prefix.

    A page is compared with the first page of all that share a prefix shingle with it.  Where those two are similar, and
    in a family of near copies they are, nothing earlier can be, and a family of any size costs a comparison per page.
    Only pages without that luck meet all the others, where sizes and the shared shingle's places leave room for enough
    common ones; the join is split at frequent shingles (AQE).  Whole sets are made again, from the texts, for pages that
    share a prefix shingle.
    """
    need = F.ceil(F.col("n") * percent / 100.0)
    hashed = shingles(pages).withColumn("shingles", F.sort_array("shingles")).withColumns({"n": F.size("shingles"), "digest": F.xxhash64("shingles", F.size("shingles"))})
    lead = F.slice("shingles", 1, (F.col("n") - need + F.ceil(need / 4)).cast("int"))
    sized = materialize(hashed.select("site_id", "page_seq", "url", "n", "digest", lead.alias("lead")))
    one = sized.groupBy("site_id", "digest")  # one page stands for a class: the rows of one digest carry equal sets
    earliest = F.min(F.struct("page_seq", "url")).alias("m")
    classes = materialize(one.agg(earliest, F.first("n").alias("n")).select("site_id", "digest", F.col("m.page_seq").alias("rep"), F.col("m.url").alias("rep_url")))
    leads = one.agg(earliest, F.first("n").alias("n"), F.first("lead").alias("lead"))
    tokens = leads.select("site_id", F.col("m.page_seq").alias("rep"), "n", F.size("lead").alias("k"), F.explode("lead").alias("s"))
    # a page holds a shingle once, so even one of all pages is a small part of the tokens
    held = tokens.withColumn("df", F.count("*").over(Window.partitionBy("s", "site_id"))).filter("df > 1")
    mine = Window.partitionBy("rep", "site_id")
    place = F.row_number().over(mine.orderBy("df", "s")) + F.col("k") - F.count("*").over(mine)
    prefix = materialize(held.withColumn("place", place).filter(F.col("place") <= F.col("n") - need + 1).select("site_id", "rep", "n", "k", "s", "place"))

    first = prefix.groupBy("site_id", "s").agg(F.min("rep").alias("first"), F.count("*").alias("pages")).filter("pages > 1")
    met = materialize(prefix.join(first, ["site_id", "s"]).groupBy("site_id", "rep").agg(F.min("first").alias("first")))
    again = pages.join(met.select("site_id", F.col("rep").alias("page_seq")), ["site_id", "page_seq"], "left_semi").dropDuplicates(["site_id", "page_seq"])
    sets = materialize(shingles(again).select("site_id", F.col("page_seq").alias("rep"), "shingles"))
    tried = met.filter("first < rep")
    lucky = materialize(_similar(tried, sets, percent))
    rest = tried.join(lucky, ["site_id", "rep"], "left_anti").select("site_id", "rep")
    a, b = prefix.alias("a"), prefix.join(rest, ["site_id", "rep"], "left_semi").alias("b")
    fits = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    most = 1 + F.least(F.col("a.k") - F.col("a.place"), F.col("b.k") - F.col("b.place"))  # common ones of the leads from this shingle on
    room = (100 + percent) * (most + F.greatest(F.col("a.n") - F.col("a.k"), F.col("b.n") - F.col("b.k"))) >= percent * (F.col("a.n") + F.col("b.n"))
    same = (F.col("a.site_id") == F.col("b.site_id")) & (F.col("a.s") == F.col("b.s"))
    pairs = a.join(b, same & (F.col("a.rep") < F.col("b.rep")) & fits & room).select(F.col("a.site_id").alias("site_id"), F.col("a.rep").alias("first"), F.col("b.rep").alias("rep")).distinct()
    best = lucky.unionByName(_similar(pairs, sets, percent))
    named = best.join(classes.select("site_id", F.col("rep").alias("f"), "rep_url"), (best["site_id"] == classes["site_id"]) & (F.col("m.first") == F.col("f"))).select(
        best["site_id"], "rep", F.struct(F.col("m.first").alias("seq"), F.col("rep_url").alias("url"), F.col("m.similarity").alias("similarity")).alias("best")
    )
    own = F.struct(F.col("rep").alias("seq"), F.col("rep_url").alias("url"), F.lit(1.0).alias("similarity"))
    named = classes.join(named, ["site_id", "rep"], "left").select("site_id", "digest", F.least(own, F.col("best")).alias("e"))
    found = sized.select("site_id", "page_seq", "url", "digest").join(named, ["site_id", "digest"]).filter(F.col("e.seq") < F.col("page_seq"))
    return found.select("site_id", "page_seq", "url", F.col("e.url").alias("near_duplicate_of"), F.col("e.similarity").alias("similarity"))
