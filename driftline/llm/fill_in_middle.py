"""Fill-in-the-middle transformation: DuckDB SQL over each Arrow batch, inside ``mapInArrow``.

A text is cut into units at two hashed places; prefix, middle and suffix are put into a new order between marks.  Every
step is an SQL expression of an in-memory DuckDB of the worker, from the batch that is registered with it to the Arrow
table that it returns; no row passes through Python.  The choices depend on the row's id alone, so reruns, other
partitions and lost executors give the same output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import own_columns

#: Bytes of text that a statement is given at a time.
BATCH_BYTES = 8_000_000


@dataclass(frozen=True)
class MiddleSettings:
    """Seed of the hashes, percentage that is transformed and of those the one with the suffix first, units and marks."""

    seed: str = "1"
    transformed: int = 90
    suffix_first: int = 20
    unit: str = "[A-Za-z]+|[^A-Za-z]"
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def middle_sql(source: str, settings: MiddleSettings) -> str:
    """The transformation of ``source`` (id, text) as a statement: id, n, form, output, prefix_chars, middle_chars, output_sha256."""
    p, s, m = _quoted(settings.prefix_mark), _quoted(settings.suffix_mark), _quoted(settings.middle_mark)
    number = lambda i: f"CAST('0x' || hash[{8 * i - 7}:{8 * i}] AS UBIGINT)"
    return f"""
WITH hashed AS (
  SELECT id, coalesce(text, '') AS text, sha256({_quoted(settings.seed)} || ':' || coalesce(CAST(id AS VARCHAR), '')) AS hash FROM {source}
), cut AS (
  SELECT id, text, regexp_extract_all(text, {_quoted(settings.unit)}) AS units, {number(1)} AS h1, {number(2)} AS h2,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {number(3)} % 100 >= {settings.transformed} THEN 'plain'
      WHEN {number(4)} % 100 < {settings.suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), placed AS (
  SELECT id, text, units, form, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM cut
), parts AS (
  SELECT id, text, form, n,
    CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(units, 1, a), '') END AS prefix,
    CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(units, a + 1, b), '') END AS middle,
    CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(units, b + 1, n), '') END AS suffix
  FROM placed
), made AS (
  SELECT id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
  FROM parts
)
SELECT id, CAST(n AS BIGINT) AS n, form, output, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, sha256(output) AS output_sha256 FROM made
"""


_ENGINE: list[duckdb.DuckDBPyConnection] = []


def _engine() -> duckdb.DuckDBPyConnection:
    """The worker's DuckDB: in memory, one thread, nothing spilled to local disk."""
    if not _ENGINE:
        _ENGINE.append(duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True}))
    return _ENGINE[0]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows up to a few megabytes of text at a time (a longer text alone), without copying."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fill_in_middle(docs: DataFrame, settings: MiddleSettings = MiddleSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n (units), form (plain, psm or spm), output, prefix_chars, middle_chars, output_sha256.

    With h1 to h4 the first four groups of 8 hexadecimal digits of the hash of seed and id, the prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger; h3 and h4 choose the form.

    Edge cases: a null text is empty; empty texts and those that hold a mark stay plain, with null lengths; a part may
    be empty; rows that repeat an id make the same choices, a null id hashes as an empty string; an empty table gives
    an empty result; other columns are ignored; a text is transformed whole whatever its length.
    """
    source = own_columns(docs, id_col, text_col)
    statement = middle_sql("batch", settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine()
        for whole in batches:
            for part in _slices(whole):
                engine.register("batch", pa.table(part.columns, names=["id", "text"]))
                made = engine.sql(statement).to_arrow_table()
                engine.unregister("batch")
                yield from made.rename_columns([id_col, *made.column_names[1:]]).to_batches()

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, output string, prefix_chars long, middle_chars long, output_sha256 string")


def restored(output: Column, form: Column, settings: MiddleSettings = MiddleSettings()) -> Column:
    """The text from output and form: marks of a transformed output occur once each, since its text held none."""
    p, s, m = settings.prefix_mark, settings.suffix_mark, settings.middle_mark
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, p, -1), s, 1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, s, -1), p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
