"""Fill-in-the-middle texts by rotation of blocks in place, and the way back.

A text is cut into units, a word with the white space before it or white space at the end. Two cuts, drawn from a hash of the seed and the document's id, split it into prefix,
middle and suffix. The sentinels are put into a bytearray of the text, which gives <P>prefix<M>middle<S>suffix, and blocks that stand side by side are exchanged by three
reversals: <M>middle and <S>suffix for the form psm, <P>prefix<M>middle and <S>suffix for the form spm. The way back finds the sentinels, rotates the blocks
back and takes the sentinels out. A text that holds a sentinel of its own stays plain; sentinels begin with "<" and end with ">", so none can arise
where a piece of text meets one.

Null texts count as empty; empty texts stay plain and have no unit. A null id is drawn for as an empty string. Texts of any length are handled whole; repeated
rows get equal results; an empty table gives an empty table; columns other than doc_id and text are not read, whatever they are called. Nothing is shuffled.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadwarden.llm.common import in_pieces, texts_of

SEED, CHANGED_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: bytes) -> np.ndarray:
    """Where the units of a text in UTF-8 end: at the last byte of each word, and at the end of white space behind the last one."""
    word = ~_WHITE[np.frombuffer(data, dtype=np.uint8)]
    ends = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    return np.r_[ends, len(data)] if len(data) and not word[-1] else ends


def draws(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def rotate(buffer: bytearray, a: int, b: int, c: int) -> None:
    """Exchanges the blocks a:b and b:c in place: each is reversed, then both together."""
    for lo, hi in ((a, b), (b, c), (a, c)):
        buffer[lo:hi] = buffer[lo:hi][::-1]


def rearrange(data: bytes, doc_id, seed: int, changed: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = unit_ends(data)
    n = len(ends)
    if not data or h3 % 100 >= changed or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    buffer = bytearray(data)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < spm else "psm"
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return n, form, len(data[:first].decode()), len(data[first:second].decode()), bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text that `output` was made of."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    else:
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    # now <P>prefix<M>middle<S>suffix
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at:at + len(sentinel)]
    return bytes(buffer)


def transform(docs: DataFrame, seed: int = SEED, changed_percent: int = CHANGED_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches):
            found = [rearrange(t.encode(), d, seed, changed_percent, spm_percent) for d, t in zip(piece.column(0).to_pylist(), texts_of(piece.column(1)))]
            n, form, prefix, middle, output = zip(*found)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                                              pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """The rows of `transform` with the texts rebuilt from output and form, as column `restored`."""
    source = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, text_at=5):
            texts = [restored(o.encode(), f) for f, o in zip(piece.column(2).to_pylist(), texts_of(piece.column(5)))]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*piece.schema.names, "restored"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


#: The same rows in DuckDB; white space and units by regular expression, blocks by slices of the list of units.
SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbered AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
