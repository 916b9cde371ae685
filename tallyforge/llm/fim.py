"""Fill-in-middle transformation: DuckDB on each Arrow batch, no Python for single rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.batches import slices
from tallyforge.session import ship_package

#: A unit is a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle. No mark begins as another ends, so a mark is found where it was set.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SQL = """
WITH cut AS (
    SELECT row_no, text, regexp_extract_all(text, '{unit}') AS u, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS d FROM batch
), drawn AS (
    SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (len(u) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= {rate} THEN 'plain'
            WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), split AS (
    SELECT row_no, text, n, form,
        CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, 1, least(x, y)), ''), '') END AS p,
        CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), ''), '') END AS m,
        CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, greatest(x, y) + 1, n), ''), '') END AS s
    FROM drawn
)
SELECT row_no, n::BIGINT AS n, form, length(p)::BIGINT AS prefix_chars, length(m)::BIGINT AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || p || '{s}' || s || '{m}' || m ELSE '{s}' || s || '{p}' || p || '{m}' || m END AS output
FROM split ORDER BY row_no
"""

_workers: dict = {}


def _connection():
    """One connection a worker; single-threaded, as Spark deals out the work."""
    import duckdb

    if "con" not in _workers:
        _workers["con"] = duckdb.connect(config={"threads": 1})
    return _workers["con"]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    A text of n units is cut at two places drawn from sha256 of ``seed:id``. ``rate`` in a hundred texts
    are transformed, ``spm`` in a hundred of those with the suffix first. Null texts count as empty, and a
    null id as an empty string; empty texts and texts that hold a mark stay plain, with null sizes. Rows with
    the same id are cut by the same draws. Extra columns are ignored, an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sql = _SQL.format(unit=UNIT, seed=int(seed), rate=int(rate), spm=int(spm), p=PREFIX, s=SUFFIX, m=MIDDLE)

    def run(batches):
        con = _connection()
        for some in slices(batches):
            given = pa.table([pa.array(range(some.num_rows), pa.int32()), some.column(0), some.column(1)], ["row_no", "id", "text"])
            con.register("batch", given)
            done = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("batch")
            columns = [done.column(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
            yield from pa.table([some.column(0), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"]).to_batches()

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)

    def part(x, mark, k):
        return F.split_part(x, F.lit(mark), F.lit(k))

    rest = {"psm": part(body, SUFFIX, 2), "spm": part(body, PREFIX, 2)}
    psm = F.concat(part(body, SUFFIX, 1), part(rest["psm"], MIDDLE, 2), part(rest["psm"], MIDDLE, 1))
    spm = F.concat(part(rest["spm"], MIDDLE, 1), part(rest["spm"], MIDDLE, 2), part(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row; see transform."""
    done = transform(docs, id_col, text_col, **options)
    back = restored(F.col("output"), F.col("form"))
    return done.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256")
    )


#: The same rows from places in the text instead of lists of units.
ORACLE_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS d,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), h AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t
), f AS (
    SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        list_sum(list_transform(u[1:least(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))) AS a0,
        list_sum(list_transform(u[1:greatest(h1 % (n + 1), h2 % (n + 1))], lambda x: length(x))) AS b0 FROM h
), g AS (
    SELECT *, coalesce(a0, 0)::BIGINT AS a, coalesce(b0, 0)::BIGINT AS b FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
        ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM g
"""
