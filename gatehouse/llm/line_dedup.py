"""Line dedup by winnowing over line hashes, with DataFrame operations only.

A repeated run is a run of at least ``run`` consecutive non-blank lines that also occurs at another place.  Of the
places where a run of exactly ``run`` lines occurs, the first by (id, text digest, line number) keeps it; every line
of every later occurrence is deleted, so later copies of longer runs go as a whole.  Blank lines are not counted and
stay where they are.

Winnowing finds the runs.  Over the hashes of a document's non-blank lines, each window of ``run`` lines selects its
smallest hash (the rightmost of equal ones) as a fingerprint.  Two equal runs of ``run`` lines select the same line,
so every repeated run is guaranteed to share a fingerprint:

1. one row per fingerprint position, with the hashes around it, as far as its windows reach (both ways);
2. fingerprints that occur once are dropped by a count with map-side combine;
3. the positions that are left are extended both ways: each window that selected the fingerprint is named by the
   digest of all its lines.  The first place of each window is kept with a ``min`` (map-side combine), and every
   other place is a later repeat.  No pairs are formed, so a passage in a million documents costs a million rows, and
   those look up its first place in several tasks.

Line hashes have 64 bits and only select; windows are compared by 128 bits.

With ``passage_words`` set, shorter runs count too: a run of one line or more that has more than that many words and
also occurs at another place.  Each such run is a window of its own size, so texts of fewer than ``run`` lines take
part; the first place keeps it as above.  A line's first place is never deleted: a later run's lines all stand in the
first one too.  Without it only runs of ``run`` lines are deleted, and a single repeated line stays at any length.

Where a later occurrence overlaps the first one, as in a line repeated many times, the shared lines go too: one
period of the repetition is left.

Edge cases: a null text stays null and an empty one stays empty; texts of fewer than ``run`` non-blank lines are left
alone without ``passage_words``; rows that are equal in id and text share one place and one fate; a document whose lines all go stays, with
an empty text (or its blank lines); a last line break is kept if the text had one; an empty table gives an empty
result; extra columns pass through, except those named like a result column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.llm._scratch import Scratch, meet, row_key

_ADDED = ("kept_text", "n_lines", "n_deleted")
#: Characters that make a line blank, and the pattern of a line that is not.
_FILLED = r"[^\x20\x09-\x0D]"
_WORD = _FILLED + "+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(filled: Column, run: int, passage_words: int | None) -> Column:
    """Per window: its first line, its lines, the place of its fingerprint, the fingerprint and the digest of its lines.

    ``filled`` holds structs of hash and digest of the non-blank lines in order; lines are counted among those.
    """
    n = F.size(filled)

    def window(i: Column, size: int) -> Column:
        part = F.slice(filled, i + 1, F.lit(size))
        # places count down so that the smallest pair is the rightmost of equal hashes
        least = F.array_min(F.transform(part, lambda x, k: F.struct(x.hash.alias("hash"), (-k).alias("back"))))
        name = F.unhex(F.md5(F.array_join(F.transform(part, lambda x: x.digest), ",")))
        return F.struct(i.alias("at"), F.lit(size).alias("size"), (i - least["back"]).alias("place"), least["hash"].alias("print"), name.alias("name"))

    def long_enough(i: Column, size: int) -> Column:
        return F.aggregate(F.slice(filled, i + 1, F.lit(size)), F.lit(0), lambda total, x: total + x.words) > passage_words

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(0), n - size)
        if size < run:
            starts = F.filter(starts, lambda i: long_enough(i, size))
        return F.when(n >= size, F.transform(starts, lambda i: window(i, size))).otherwise(F.array())

    return F.concat(*[of_size(size) for size in range(run if passage_words is None else 1, run + 1)])


def delete_repeated_runs(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (not blank) and ``n_deleted``.

    ``passage_words`` also deletes later copies of shorter runs of more words than that, see above.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    columns = [c for c in docs.columns if c not in _ADDED or c in (id_col, text_col)]
    inner = {c: f"d{i}" for i, c in enumerate(columns)}
    doc_id, text = F.col(inner[id_col]), F.col(inner[text_col])
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()])
    rows = rows.withColumn("key", row_key(doc_id, text))

    numbered = rows.where(text.isNotNull()).select(doc_id.alias("id"), "key", F.filter(_lines(text), lambda x: x.rlike(_FILLED)).alias("lines"))
    words = (lambda x: [F.regexp_count(x, F.lit(_WORD)).alias("words")]) if passage_words is not None else (lambda x: [])
    hashed = numbered.where(F.size("lines") >= (run if passage_words is None else 1)).select(
        "id", "key", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("hash"), F.md5(x).alias("digest"), *words(x))).alias("filled")
    )
    windows = hashed.select("id", "key", F.explode(_windows(F.col("filled"), run, passage_words)).alias("w")).select("id", "key", "w.*")
    windows = scratch.save(windows, "windows")
    # fingerprints with more than one position
    spot = F.struct("id", "key", "place")
    shared = windows.groupBy(F.col("print").alias("p")).agg(F.min(spot).alias("one"), F.max(spot).alias("other")).where("one <> other").select("p")
    met = meet(windows, shared, [("print", "p")], "key").drop("p")
    # the windows that selected them, by all their lines
    here = F.struct("id", "key", "at")
    first = met.groupBy(F.col("name").alias("n")).agg(F.min(here).alias("one"), F.max(here).alias("other")).where("one <> other").select("n", "one")
    later = meet(met, first, [("name", "n")], "key").where(here != F.col("one")).select("key", F.struct("at", "size").alias("at"))
    gone = scratch.save(later.groupBy(F.col("key").alias("k")).agg(F.collect_set("at").alias("ats")), "gone")
    scratch.drop(windows)

    scratch.release()
    # a merge join at every size: what is deleted grows with the corpus and is never broadcast
    joined = rows.join(gone.hint("merge"), F.col("key") == F.col("k"), "left").withColumn("all", _lines(text))
    places = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).rlike(_FILLED))
    joined = joined.withColumn("places", F.when(text.isNotNull(), places))
    lost = F.transform(F.flatten(F.transform("ats", lambda a: F.sequence(a["at"], a["at"] + a["size"] - 1))), lambda k: F.get("places", k))
    stay = F.when(F.col("ats").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("all") - 1), lost))
    joined = joined.withColumn("stay", stay)
    kept = F.when(F.col("stay").isNull(), text).otherwise(F.array_join(F.transform("stay", lambda i: F.get("all", i)), "\n"))
    return joined.select(
        *[F.col(a).alias(c) for c, a in inner.items()],
        kept.alias("kept_text"),
        F.when(text.isNotNull(), F.size("places")).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("stay").isNotNull(), F.size("all") - F.size("stay")).otherwise(0).cast("long").alias("n_deleted"),
    )
