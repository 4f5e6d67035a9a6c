"""Lines of a five-column export: loaded records and rejected lines.

Each line is one record of ``mol_id,smiles,title,mol_weight,registered_on``.
The structure is judged first: quoting by a grammar over the line, the number
of fields by the CSV reader's callback for invalid rows. All fields are read
as strings; whole columns are then cast, and the cells that fail name the
reason. ``reason`` is the first that applies of ``quoting``, ``columns``,
``mol_id``, ``smiles``, ``mol_weight`` and ``registered_on``.

Defined results for odd input: a NULL or empty line is rejected with
``columns``; a line delivered several times counts once; an empty table gives
empty tables; other columns of the table are ignored; a field may hold line
breaks and any characters. A whole digit string beyond 18 digits is a good
``mol_id`` whose loaded value is NULL when it exceeds LONG.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.functions.smiles import is_readable, key_of
from chemlattice.session import spread

FIELDS = ["mol_id", "smiles", "title", "mol_weight", "registered_on"]
REASONS = ["quoting", "columns", *(f for f in FIELDS if f != "title")]
_GRAMMAR = r'^(?s:(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*)\z'
_DECIMAL = r"^\+?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
# Line breaks inside a line are rewritten while the CSV reader sees it.
_MARK = "\ue000"
_OUT = (
    "line_id long, reason string, mol_id long, smiles string, title string, mol_weight double, registered_on date"
)
_ARROW = pa.schema(
    [("line_id", pa.int64()), ("reason", pa.string()), ("mol_id", pa.int64()), ("smiles", pa.string()), ("title", pa.string()), ("mol_weight", pa.float64()), ("registered_on", pa.date32())]
)


def _hide(x: pa.Array) -> pa.Array:
    for a, b in ((_MARK, _MARK + "0"), ("\n", _MARK + "1"), ("\r", _MARK + "2")):
        x = pc.replace_substring(x, a, b)
    return x


def _show(x: pa.Array) -> pa.Array:
    for a, b in (("\n", _MARK + "1"), ("\r", _MARK + "2"), (_MARK, _MARK + "0")):
        x = pc.replace_substring(x, b, a)
    return x


def _days(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which strings are existing days, and the days since 1970."""
    shaped = np.asarray(pc.match_substring_regex(text, _DATE))
    safe = pc.if_else(pa.array(shaped), text, "1970-01-01")
    part = lambda a, b: np.asarray(pc.cast(pc.utf8_slice_codeunits(safe, a, b), pa.int64()))
    y, m, d = part(0, 4), part(5, 7), part(8, 10)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    month_ok = (m >= 1) & (m <= 12)
    last = length[np.where(month_ok, m, 0)] + (leap & (m == 2))
    good = shaped & month_ok & (d >= 1) & (d <= last) & (y >= 1)
    safe = pc.if_else(pa.array(good), safe, "1970-01-01")
    return good, np.asarray(pc.cast(pc.cast(safe, pa.date32()), pa.int32()))


def split_batch(line_id: pa.Array, raw: pa.Array) -> pa.RecordBatch:
    """One row for each line: its record, or the reason why there is none."""
    n = len(raw)
    reason = np.full(n, None, object)
    empty = np.asarray(pc.fill_null(pc.equal(raw, ""), True))
    text = pc.fill_null(raw, "")
    text = pc.replace_substring_regex(text, r"\r\z", "")
    reason[empty] = "columns"
    sound = np.asarray(pc.match_substring_regex(text, _GRAMMAR))
    reason[~empty & ~sound] = "quoting"
    # What is left has sound quoting. The row number goes in front, so that a row handed to the callback can be named.
    at = np.flatnonzero(sound & ~empty)
    blank = np.asarray(pc.equal(text, ""))
    reason[blank] = "columns"
    at = at[~blank[at]]
    rows = pc.binary_join_element_wise(pa.array(at.astype(str)), _hide(text.take(pa.array(at))), ",")
    rejected: list[int] = []

    def invalid(row: pcsv.InvalidRow) -> str:
        rejected.append(int(row.text.split(",", 1)[0].strip('"')))
        return "skip"

    names = ["at", *FIELDS]
    if len(at):
        buffer = "\n".join(rows.to_pylist()) + "\n"
        data = buffer.encode()
        got = pcsv.read_csv(
            io.BytesIO(data),
            read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(data) + 1, 1 << 16)),
            parse_options=pcsv.ParseOptions(delimiter=",", quote_char='"', double_quote=True, escape_char=False, newlines_in_values=False, invalid_row_handler=invalid, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        ).combine_chunks()
    else:
        got = pa.table({c: pa.array([], pa.string()) for c in names})
    reason[rejected] = "columns"
    columns = {c: _show(got[c].combine_chunks() if isinstance(got[c], pa.ChunkedArray) else got[c]) for c in FIELDS}
    where = np.asarray(pc.cast(got["at"], pa.int64()).to_numpy(zero_copy_only=False), np.int64)

    id_ok = np.asarray(pc.match_substring_regex(columns["mol_id"], r"^[0-9]+\z"))
    smiles = columns["smiles"].to_pylist()
    smiles_ok = np.fromiter((is_readable(s) for s in smiles), bool, len(smiles))
    no_weight = np.asarray(pc.equal(columns["mol_weight"], ""))
    weight_ok = np.asarray(pc.match_substring_regex(columns["mol_weight"], _DECIMAL))
    weight = pc.cast(pc.if_else(pa.array(weight_ok), pc.utf8_ltrim(columns["mol_weight"], "+"), "0"), pa.float64())
    weight_np = weight.to_numpy(zero_copy_only=False)
    # Above zero is a matter of the digits: a value too small for a double still counts.
    digits = np.asarray(pc.match_substring_regex(columns["mol_weight"], r"^[^eE]*[1-9]"))
    weight_ok = no_weight | (weight_ok & ((weight_np > 0) | digits))
    day_ok, days = _days(columns["registered_on"])
    why = np.full(len(where), None, object)
    for ok, name in ((day_ok, "registered_on"), (weight_ok, "mol_weight"), (smiles_ok, "smiles"), (id_ok, "mol_id")):
        why[~ok] = name
    reason[where] = why

    loaded = why == None  # noqa: E711
    place = np.full(n, -1)
    place[where[loaded]] = np.flatnonzero(loaded)
    index = pa.array(place, mask=place < 0)
    short = np.asarray(pc.less_equal(pc.utf8_length(pc.utf8_ltrim(columns["mol_id"], "0")), 18))
    ids = pc.cast(pc.if_else(pa.array(id_ok & short), columns["mol_id"], None), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pc.cast(line_id, pa.int64()),
            pa.array(reason, pa.string()),
            ids.take(index),
            pa.array([key_of(s) for s in smiles], pa.string()).take(index),
            columns["title"].take(index),
            pa.array(weight_np, mask=no_weight).take(index),
            pa.array(days, pa.int32()).cast(pa.date32()).take(index),
        ],
        schema=_ARROW,
    )


def split_lines(lines: DataFrame, id_col: str = "line_id", raw_col: str = "raw") -> DataFrame:
    """``line_id, reason`` and the five typed columns; ``reason`` is NULL for a loaded record.

    A narrow step: no shuffle, but for a table of fewer splits than slots. Lines delivered twice are not removed here.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield split_batch(b.column(0), b.column(1))

    return spread(lines).select(F.col(id_col).cast("long").alias("line_id"), F.col(raw_col).cast("string").alias("raw")).mapInArrow(each, _OUT)


def rejected(lines: DataFrame, **cols: str) -> DataFrame:
    """``line_id, reason`` of each line that does not load, once."""
    return split_lines(lines, **cols).where("reason is not null").select("line_id", "reason").distinct()


def loaded(lines: DataFrame, **cols: str) -> DataFrame:
    """The typed records of the lines that load, once for each line; ``line_id`` goes with them."""
    return split_lines(lines, **cols).where("reason is null").drop("reason").dropDuplicates(["line_id"])
