"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A paragraph here is a passage that ends where the content says so. Runs of up to six words inside a sentence are the smallest; at scale s a
passage ends after each run whose hash has s bits of zeros, so after 2**s runs on average, and an edit moves no border but those beside it.
A text has the passages of three scales, the finest one with about 16 to 32 of them, whatever its length (equal runs count once for that).
Two texts are compared at the scales that both have, so a text and its edit, whose numbers of runs differ, lose nothing by that; those that differ
more than sevenfold may share no scale and are then not alike. Each digest goes to one cell in each of three subtables; a cell holds a count, the xor of its digests and the xor of
their check values. Subtracting the sketches of two versions leaves what only one of them has; cells with a single digest give it away, and
taking it out of its other cells makes more such cells, until nothing is left (both differences are known) or nothing is single (failure).
On failure the same is tried with larger sketches, the digests dealt anew, until it peels.

Cells are rows, built and subtracted by one grouping that needs no shuffle of its own, as a document's rows are already together. Each round
of peeling looks at one subtable, where a digest has one cell only, so no digest is taken out twice. The fingerprint is the sketch of
FINGERPRINT_CELLS cells a subtable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.llm.common import Scratch, with_row_key

TABLES, FIRST_CELLS, GROWTH, FINGERPRINT_CELLS = 3, 128, 4, 8
ROUNDS = 9
RUN = r"\S+(?:(?<![.!?])[^\S\n]+\S+){0,5}"
LEAST_PASSAGES, MARKS = 16, "\x01\x02\x03"  # a mark for each scale
BUCKET_ROWS, OUTER_CUTS, INNER_CUTS = 1024, 256, 4096
MOST_PARTITIONS = 100_000  # of two ranges each; beyond it they hold more
EDITED, NEXT, OWN, OWN_EDITED, FACTS = 0, 1, 2, 3, 4  # kinds of cells: two differences, two fingerprints; and a row of what is known
ADDED, GONE = -1, -2  # "cells" that count what was peeled


def _bind(value: Column, fn) -> Column:
    """fn(value), where fn may use the value often: as a lambda's variable it is made once."""
    return F.transform(F.array(value), fn)[0]


def digests(text: Column) -> Column:
    """The distinct digests (s: scale, h) of a text's passages at its three scales; null, empty and blank texts have none."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))

    def passages(w: Column) -> Column:
        def marked(least: Column) -> Column:
            def end(h: Column) -> Column:
                kind = F.lit(" ")
                for k, mark in enumerate(MARKS):
                    kind = F.when(h.bitwiseAND(least * (1 << k) - 1) == 0, mark).otherwise(kind)
                return kind

            return F.rtrim(F.array_join(F.transform(w, lambda x: F.concat(x, _bind(F.xxhash64(x), end))), ""))

        def hashed(t: Column, scale: Column) -> Column:
            def at(k: int) -> Column:  # at a coarser scale the finer marks are spaces
                parts = F.split(F.translate(t, MARKS[:k], " " * k), f"[{MARKS[k:]}]")
                return F.transform(parts, lambda p: F.when(p != "", F.struct((scale + k).alias("s"), F.xxhash64(p, scale + k).alias("h"))))

            return F.array_compact(F.array_distinct(F.concat(*map(at, range(len(MARKS))))))

        scale = F.greatest(F.lit(0), F.floor(F.log2(F.size(F.array_distinct(w)) / LEAST_PASSAGES))).cast("int")
        return _bind(scale, lambda s: _bind(_bind(F.call_function("shiftleft", F.lit(1).cast("bigint"), s), marked), lambda t: hashed(t, s)))

    return _bind(runs, lambda w: F.when(F.size(w) > 0, passages(w)).otherwise(F.array().cast("array<struct<s:int,h:bigint>>")))


def _shared(a: Column, b: Column) -> Column:
    """The digests of ``a`` at the scales that ``b`` has too."""
    least = lambda x: F.array_min(F.transform(x, lambda d: d["s"]))
    scales = F.struct(F.greatest(least(a), least(b)).alias("from"), (F.least(least(a), least(b)) + len(MARKS) - 1).alias("to"))
    return F.when(F.size(b) > 0, _bind(scales, lambda s: F.transform(F.filter(a, lambda d: (d["s"] >= s["from"]) & (d["s"] <= s["to"])), lambda d: d["h"]))).otherwise(F.transform(a, lambda d: d["h"]))


def _passed(cuts: Column, x: Column, step: int) -> Column:
    """How many of the ascending cuts are at most x, searched in two steps."""

    def within(every: Column) -> Column:
        outer = F.filter(every, lambda c, i: F.pmod(i, F.lit(step)) == 0)
        below = F.greatest(F.size(F.filter(outer, lambda c: c <= x)) - 1, F.lit(0)) * step
        return below + F.size(F.filter(F.slice(every, below + 1, F.lit(step)), lambda c: c <= x))

    return _bind(cuts, within)


def _buckets(work: Scratch, rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """Adds ``bucket``: ranges of about BUCKET_ROWS rows in descending id, cut at quantiles; null ids come last.

    OUTER_CUTS quantiles go into the expression; beyond that many ranges each is cut again, at quantiles that come from a table of a row for
    each, at most INNER_CUTS long, so the table has a bound.
    """
    wanted = max(1, n // BUCKET_ROWS)
    outer = min(OUTER_CUTS, wanted)
    found = rows.agg(F.percentile_approx(id_col, [i / outer for i in range(1, outer)], 20 * outer).alias("c")).first()["c"] if outer > 1 else None
    cuts = F.array(*(F.lit(c).cast("bigint") for c in sorted(set(found or [])))).cast("array<bigint>")
    x = F.col(id_col)
    rows = rows.withColumn("range", F.when(x.isNull(), F.lit(-1)).otherwise(_passed(cuts, x, 16)))
    inner = min(INNER_CUTS, -(-wanted // outer))
    if inner > 1:
        # Saved, as two jobs read it and another run might cut otherwise.
        table = rows.groupBy("range").agg(F.array_distinct(F.percentile_approx(id_col, [i / inner for i in range(1, inner)], 20 * inner)).alias("cuts"))
        table = work.save(table, "cuts")
        rows = rows.join(F.broadcast(table), "range").withColumn("place", F.coalesce(_passed(F.col("cuts"), x, 64), F.lit(0))).drop("cuts")
    else:
        rows = rows.withColumn("place", F.lit(0))
    return rows.withColumn("bucket", -(F.col("range").cast("bigint") * INNER_CUTS + F.col("place"))).drop("range", "place")


def with_next(work: Scratch, docs: DataFrame, id_col: str, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """Each row with ``added`` and, as next_<column>, the columns and added ones of the row that follows in descending id (after the last: the
    first), a key ``row`` and the range ``b`` that it is partitioned by.

    Each range of ids also gets a copy of the first row of the range after it, so that one shuffle and a window within the range do. That
    row is taken with its content in one job, so no key of a scan is used by another. Repeated ids follow by a hash of their columns; rows of a null id
    come last. Rows of one id stay in one range.
    """
    n_rows = docs.count()
    rows = _buckets(work, docs.select(*columns), id_col, n_rows).withColumn("tie", F.xxhash64(*columns))
    heads = rows.groupBy("bucket").agg(F.max_by(F.struct(*columns, "tie"), F.struct(F.col(id_col), F.bitwise_not("tie"))).alias("h"))
    heads = work.save(heads, "heads")  # one row per range, OUTER_CUTS * INNER_CUTS at most
    around = Window.orderBy("bucket")  # numbers only
    first = F.min("bucket").over(Window.partitionBy())
    order = heads.select(F.col("bucket").alias("b"), F.coalesce(F.lead("bucket").over(around), first).alias("bucket"))
    ghosts = heads.join(order, "bucket").select("h.*", "b", F.lit(True).alias("ghost"))
    rows = rows.withColumnRenamed("bucket", "b").withColumn("ghost", F.lit(False)).unionByName(ghosts)
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), **added}).repartition(min(MOST_PARTITIONS, -(-n_rows // (2 * BUCKET_ROWS)) or 1), "b")
    order = Window.partitionBy("b").orderBy("ghost", F.col(id_col).desc_nulls_last(), "tie", "row")
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in (*columns, *added)))
    return rows.filter(~F.col("ghost")).drop("ghost", "tie")


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(-1))


def _cell(d: Column, table: Column | int, cells: int, deal: int) -> Column:
    """The cell of a digest; those of a smaller sketch of the same deal are the larger one's folded."""
    t = F.lit(table) if isinstance(table, int) else table
    return (t * cells + F.xxhash64(d, t, F.lit(deal)).bitwiseAND(F.lit(cells - 1))).cast("int")


KEYS = ["b", "row", "kind", "cell", "facts"]


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))


def _sketches(rows: DataFrame, cells: int, deal: int) -> DataFrame:
    """The cells of both differences and both fingerprints, and a row of facts, for rows of _edited."""
    lists = [(EDITED, 1, "d_e"), (EDITED, -1, "e_d"), (NEXT, 1, "d_n"), (NEXT, -1, "n_d"), (OWN, 1, "d"), (OWN_EDITED, 1, "e"), (FACTS, 1, F.array(F.lit(0).cast("bigint")))]
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("n"), (F.col(x) if isinstance(x, str) else x).alias("d")) for kind, n, x in lists)))
    rows = rows.select("b", "row", "facts", each.alias("l"))
    rows = rows.select("b", "row", F.when(F.col("l.kind") == FACTS, F.col("facts")).alias("facts"), "l.kind", "l.n", F.explode("l.d").alias("key"))
    rows = rows.select("*", _check(F.col("key")).alias("check"), F.explode(F.array(*map(F.lit, range(TABLES)))).alias("t")).filter(f"kind <> {FACTS} OR t = 0")
    at = F.when(F.col("kind") <= NEXT, _cell(F.col("key"), F.col("t"), cells, deal)).when(F.col("kind") == FACTS, 0).otherwise(_cell(F.col("key"), F.col("t"), FINGERPRINT_CELLS, 0))
    return _sums(rows.withColumn("cell", at))


def _peeled(state: DataFrame, cells: int, deal: int) -> DataFrame:
    """The cells after ROUNDS rounds, with ADDED and GONE counts of the digests that were found."""
    own = lambda cell, n, key, check: F.struct(cell.cast("int").alias("cell"), n.alias("n"), key.alias("key"), check.alias("check"))
    n, key, check, zero = F.col("n"), F.col("key"), F.col("check"), F.lit(0).cast("bigint")
    for k in range(ROUNDS):
        table = k % TABLES
        single = (F.col("kind") <= NEXT) & (F.col("cell") >= table * cells) & (F.col("cell") < (table + 1) * cells) & (F.abs(n) == 1) & (check == _check(key))
        found = own(F.when(n == 1, ADDED).otherwise(GONE), F.lit(1).cast("bigint"), zero, zero)
        others = [own(_cell(key, t, cells, deal), -n, key, check) for t in range(TABLES) if t != table]
        state = state.select("b", "row", "kind", "facts", F.inline(F.when(single, F.array(found, *others)).otherwise(F.array(own(F.col("cell"), n, key, check)))))
        state = _sums(state).filter(f"kind > {NEXT} OR cell < 0 OR n <> 0 OR key <> 0 OR check <> 0")
    return state


def _fingerprint(kind: int) -> Column:
    """A sketch as text: its cells in order, each one's number, count, key and check in hexadecimal."""
    cells = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("cell", "n", "key", "check"))))
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["cell"]), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"]))), "-")


def _compared(rows: DataFrame, cells: int, deal: int) -> DataFrame:
    """facts, fingerprints, and both likenesses: shared digests over all digests, null where the difference did not peel."""
    state = _peeled(_sketches(rows, cells, deal), cells, deal)

    def likeness(kind: int, a: str, b: str, empty: str) -> Column:
        of = lambda cell: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("cell") == cell), F.col("n"))), F.lit(0))
        left = F.count_if((F.col("kind") == kind) & (F.col("cell") >= 0))
        n_a, n_b = (F.max(f"facts.{x}") for x in (a, b))
        return F.when(left == 0, F.when(n_a + n_b == 0, F.max(f"facts.{empty}")).otherwise((n_a - of(ADDED)) / (n_a + of(GONE))))

    both = [likeness(EDITED, "n_d_e", "n_e_d", "if_no_edited").alias("near_edited"), likeness(NEXT, "n_d_n", "n_n_d", "if_no_next").alias("near_next")]
    out = state.groupBy("b", "row").agg(F.max("facts").alias("facts"), _fingerprint(OWN).alias("fingerprint"), _fingerprint(OWN_EDITED).alias("edited_fingerprint"), *both)
    return out.drop("b", "row")


def _edited(rows: DataFrame) -> DataFrame:
    """(b, row, facts, d, e and, at shared scales, d_e and e_d, d_n and n_d) of rows with a text, the next one's, and the digests of both."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half)))
    rows = rows.select("b", "row", "id", "next_id", n.cast("long").alias("n_chars"), "d", "next_d", digests(F.col("edited")).alias("e"), F.sha2("edited", 256).alias("sha"), F.xxhash64("text").alias("h"), F.xxhash64("next_text").alias("next_h"))
    pairs = {"d_e": ("d", "e"), "e_d": ("e", "d"), "d_n": ("d", "next_d"), "n_d": ("next_d", "d")}
    rows = rows.select("*", *(_shared(F.col(x), F.col(y)).alias(name) for name, (x, y) in pairs.items()))
    none = lambda x: F.when(F.size("d") + F.size(x) == 0, 1.0).otherwise(0.0)  # noqa: E731  texts without words are alike, those without a shared scale are not
    facts = F.struct("id", "next_id", "n_chars", "sha", "h", "next_h", *(F.size(x).alias(f"n_{x}") for x in pairs), none("e").alias("if_no_edited"), none("next_d").alias("if_no_next"))
    return rows.select("b", "row", facts.alias("facts"), *pairs, *(F.transform(x, lambda y: y["h"]).alias(x) for x in ("d", "e")))


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_cells: int = FIRST_CELLS) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to the edited text's and the next document's.

    The edited text is the text with its last floor(n / 2) code points replaced by as many first ones of the next document in
    descending id. A null text counts as empty; repeated ids and rows are taken one by one; an empty table gives no rows. Equal texts have
    equal fingerprints; texts without words are alike. ``first_cells`` (a power of two): cells a subtable in the first try; the few pairs
    that do not peel are read again by id and hash of their texts, for a try with GROWTH times as many.
    """
    work = Scratch(docs.sparkSession, "sketches")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _edited(with_next(work, base, "id", ["id", "text"], {"d": digests(F.col("text"))}))
    got = work.save(_compared(rows, first_cells, 0), "try-0")
    work.drop("heads", "cuts")
    failed = F.col("near_edited").isNull() | F.col("near_next").isNull()
    done, open_, tries = got.filter(~failed), got.filter(failed), 0
    names = ["id", "h", "next_id", "next_h"]
    while not open_.isEmpty():
        tries += 1
        pairs = work.save(open_.select(*(F.col(f"facts.{x}").alias(x) for x in names)).distinct(), f"pairs-{tries}")
        # Saved first, so that Spark knows how few keys these are and need not shuffle all texts to meet them.
        keys = work.save(pairs.select(F.col("id").alias("i"), F.col("h").alias("j")).union(pairs.select("next_id", "next_h")).distinct(), f"keys-{tries}")
        texts = base.select("id", "text", F.xxhash64("text").alias("h")).join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")))
        texts = work.save(texts.groupBy("i", "j").agg(F.max("text").alias("t")), f"texts-{tries}")
        for i, h, name in (("id", "h", "text"), ("next_id", "next_h", "next_text")):
            own = work.load(f"texts-{tries}").withColumnRenamed("t", name)
            pairs = pairs.join(own, F.col(i).eqNullSafe(F.col("i")) & (F.col(h) == F.col("j"))).drop("i", "j")
        pairs = with_row_key(pairs, "row").withColumn("b", F.col("row")).withColumn("d", digests(F.col("text"))).withColumn("next_d", digests(F.col("next_text")))
        again = work.save(_compared(_edited(pairs), first_cells * GROWTH**tries, tries), f"try-{tries}")
        same = [F.col(f"o.facts.{x}").eqNullSafe(F.col(f"a.facts.{x}")) for x in names]
        likenesses = [F.coalesce(f"o.{x}", f"a.{x}").alias(x) for x in ("near_edited", "near_next")]
        joined = open_.alias("o").join(again.alias("a"), same[0] & same[1] & same[2] & same[3], "left").select("o.facts", "o.fingerprint", "o.edited_fingerprint", *likenesses)
        joined = work.save(joined, f"open-{tries}")
        work.drop(f"pairs-{tries}", f"keys-{tries}", f"texts-{tries}", f"try-{tries}")
        done, open_ = done.union(joined.filter(~failed)), joined.filter(failed)
    return done.select(F.col("facts.id").alias(id_col), "facts.n_chars", F.col("facts.sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
