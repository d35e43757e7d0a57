"""Chunked payload messages: split long texts into numbered envelopes and put them together again.

An envelope is ``TTKQR1|session|seq/total|encoding|filename|payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .aggregate import _CELL_BYTES

# The envelope marker, the longest encoding name (it reserves header room), and the
# characters one code holds at each error correction level.
MAGIC = "TTKQR1"
_LONGEST_ENCODING = "uuencode"
CAPACITY = {"L": 2953, "M": 2331, "Q": 1663, "H": 1273}
ENCODINGS = ("utf8", "base64")


def build_envelope(session: Column, seq: Column, total: Column, encoding: Column, filename: Column,
                   payload: Column) -> Column:
    """Compose one envelope text."""
    place = F.concat_ws("/", seq.cast("string"), total.cast("string"))
    return F.concat_ws("|", F.lit(MAGIC), session, place, encoding, F.coalesce(filename, F.lit("")), payload)


def parse_envelopes(df: DataFrame, column: str | int) -> DataFrame:
    """Add session, seq, total, encoding, filename, payload; all NULL where the text is not an envelope."""
    name = names.resolve(df, column)
    parts = F.split(names.col(name), r"\|", 6)
    place = F.split(F.get(parts, F.lit(2)), "/")
    seq = F.get(place, F.lit(0)).try_cast("bigint")
    total = F.get(place, F.lit(1)).try_cast("bigint")
    ours = (
        (F.size(parts) == 6) & (F.get(parts, F.lit(0)) == MAGIC) & (F.size(place) == 2)
        & seq.isNotNull() & total.isNotNull()
    )
    ours = F.coalesce(ours, F.lit(False))

    def part(i: int) -> Column:
        return F.when(ours, F.get(parts, F.lit(i)))

    added = ("is_foreign", "session", "seq", "total", "encoding", "filename", "payload")
    kept = [c for c in df.columns if c.lower() not in added]
    return df.select(
        *[names.col(c) for c in kept],
        (~ours).alias("is_foreign"),
        part(1).alias("session"),
        F.when(ours, seq).alias("seq"),
        F.when(ours, total).alias("total"),
        part(3).alias("encoding"),
        part(4).alias("filename"),
        part(5).alias("payload"),
    )


def encode_binary(content: Column) -> Column:
    """Bytes as base64 text on one line."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def decode_payload(payload: Column, encoding: Column) -> Column:
    """Payload text back to bytes; NULL for an encoding that is not known."""
    return F.when(encoding == "base64", F.unbase64(payload)).when(encoding == "utf8", F.encode(payload, "UTF-8"))


def split_messages(
    df: DataFrame,
    session: str | int,
    text: str | int,
    filename: str | int | None = None,
    encoding: str = "utf8",
    error_correction: str = "L",
    cap: int | None = None,
) -> DataFrame:
    """One row per chunk: ``session, seq, total, envelope``.

    A chunk fills what the envelope's header leaves of the capacity, and the header's length depends
    on the number of chunks. More chunks mean at most longer headers, so starting from one chunk the
    count only grows; each round can add a digit and a few rounds settle it.
    """
    if error_correction not in CAPACITY:
        raise ValueError(f"error_correction must be one of {list(CAPACITY)}")
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    limit = min(CAPACITY[error_correction], cap or CAPACITY[error_correction])
    session, text = names.resolve(df, session), names.resolve(df, text)
    file_col = names.col(names.resolve(df, filename)) if filename is not None else F.lit("")
    rows = df.select(
        names.col(session).cast("string").alias("session"),
        F.coalesce(file_col.cast("string"), F.lit("")).alias("filename"),
        names.col(text).alias("content"),
        F.coalesce(F.length(names.col(text)), F.lit(0)).cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("total"),
    )
    fixed = len(MAGIC) + len(_LONGEST_ENCODING) + 6  # five bars and the slash
    room = (
        F.lit(limit)
        - F.lit(fixed)
        - F.length("session")
        - F.length("filename")
        - F.length(F.col("total").cast("string")) * 2
    )
    checked_room = F.when(room > 0, room).otherwise(
        F.raise_error(F.lit("envelope header leaves no room for content: file name or session too long"))
    )
    needed = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("size") / F.col("room")).cast("bigint"))
    for _ in range(5):
        rows = rows.withColumn("room", checked_room.cast("bigint")).withColumn("total", needed)
    chunk = F.posexplode(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1),
            lambda i: F.substring(F.coalesce(F.col("content"), F.lit("")), (i * F.col("room") + 1).cast("int"),
                                  F.col("room").cast("int")),
        )
    ).alias("position", "payload")
    chunks = rows.select("session", "filename", "total", chunk)
    seq = F.col("position") + 1
    return chunks.select(
        "session",
        seq.alias("seq"),
        "total",
        build_envelope(F.col("session"), seq, F.col("total"), F.lit(encoding), F.col("filename"),
                       F.col("payload")).alias("envelope"),
    )


def reassemble(df: DataFrame, column: str | int, arrival: str | int) -> DataFrame:
    """One row per session: ``session, total, chunks, complete, missing, filename, encoding, content``.

    The latest copy of a chunk wins; ``total`` is that of the chunk that arrived first, as its latest copy
    has it. ``missing`` lists gaps as ``{from, to}``. ``content`` is NULL while chunks are missing. Chunks
    are first reduced to one per (session, seq), which spreads a busy session over many tasks. A message
    that no cell can hold raises with its session; :func:`parse_envelopes` gives its chunks as rows.
    """
    arrived = df.select(
        names.col(names.resolve(df, column)).alias("__text"), names.col(names.resolve(df, arrival)).alias("__arrival")
    )
    parsed = parse_envelopes(arrived, "__text").where(~F.col("is_foreign"))
    order = F.col("__arrival")
    chunks = parsed.groupBy("session", "seq").agg(
        F.max_by(F.struct("payload", "filename", "encoding", "total"), order).alias("last"), F.min(order).alias("first"),
    )
    both = chunks.groupBy("session").agg(
        F.min_by(F.col("last.total"), F.col("first")).alias("total"),
        F.max(F.when(F.col("seq") == 1, F.col("last.filename"))).alias("filename"),
        F.max(F.when(F.col("seq") == 1, F.col("last.encoding"))).alias("encoding"),
        F.array_sort(F.collect_list(F.struct("seq", F.col("last.payload").alias("payload")))).alias("chunks"),
        F.sum(F.octet_length("last.payload")).alias("size"),
    )
    inside = F.filter("chunks", lambda c: (c["seq"] >= 1) & (c["seq"] <= F.col("total")))
    both = both.withColumn("chunks", inside)
    seqs = F.transform("chunks", lambda c: c["seq"])
    before = F.concat(F.array(F.lit(0).cast("bigint")), seqs)
    after = F.concat(seqs, F.array(F.col("total") + 1))
    gaps = F.filter(
        F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("from"), (b - 1).alias("to"))),
        lambda g: g["from"] <= g["to"],
    )
    complete = F.size("chunks") == F.col("total")
    too_long = F.raise_error(F.concat(F.lit("no cell can hold the message of session "), F.col("session"))).cast("string")
    joined = F.array_join(F.transform("chunks", lambda c: c["payload"]), "")
    content = F.when(F.col("size") > _CELL_BYTES, too_long).otherwise(joined)
    return both.select(
        "session",
        "total",
        F.size("chunks").cast("bigint").alias("chunks"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
        gaps.alias("missing"),
        "filename",
        "encoding",
        F.when(complete, content).alias("content"),
    )


def foreign_texts(df: DataFrame, column: str | int) -> DataFrame:
    """Texts that are no envelopes, kept as they are with an empty file name."""
    name = names.resolve(df, column)
    foreign = parse_envelopes(df.select(names.col(name).alias("content")), "content").where(F.col("is_foreign"))
    return foreign.select("content", F.lit("").alias("filename"))
