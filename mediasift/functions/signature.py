"""File signatures read from the first bytes of a file.

All of it is built-in expressions, so the bytes never leave the JVM. The two container
walks are bounded folds: each step consumes one element, and the number of steps is
derived from the byte count that remains, so a walk can always reach the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediasift import vocab
from mediasift.functions.base import let


def header_of(content: Column) -> Column:
    return F.substring(content, 1, vocab.HEADER_BYTES)


def _uint(data: Column, start: Column | int, length: Column | int) -> Column:
    """Big-endian unsigned integer of up to 8 bytes; `start` counts from 1."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    digits = F.hex(F.substring(data, start, length))
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def has_mpeg_audio_frame(header: Column) -> Column:
    """An MPEG audio sync pair anywhere, with three more bytes after it.

    The second byte has its top three bits set and layer bits `01`. Latin-1 maps each byte
    to one character, which keeps the search aligned to bytes.
    """
    return F.decode(header, "ISO-8859-1").rlike(
        r"(?s)ÿ[âãêëòóúû].{3}"
    )


def iso_bmff_brands(header: Column) -> Column:
    """Distinct brands of the first `ftyp` box as hex text, or null if there is none."""
    size = F.length(header)
    state = "struct<pos:bigint,brands:array<string>,done:boolean>"

    def finish(brands: Column) -> Column:
        return F.struct(
            F.lit(0).cast("bigint").alias("pos"), brands.alias("brands"), F.lit(True).alias("done")
        )

    nothing = F.lit(None).cast("array<string>")

    def brands_of(start: Column, count: Column) -> Column:
        # major brand, a version to skip, then compatible brands of four bytes each
        slots = F.when(count >= 12, F.sequence(F.lit(2), F.floor(count / 4) - 1))
        offsets = F.concat(
            F.array(F.lit(0).cast("bigint")),
            F.coalesce(F.transform(slots, lambda i: i.cast("bigint")), F.array().cast("array<bigint>")),
        )
        return F.array_distinct(
            F.transform(
                offsets,
                lambda i: F.hex(F.substring(header, (start + i * 4 + 1).cast("int"), F.lit(4))),
            )
        )

    def step(acc: Column, _: Column) -> Column:
        at = acc["pos"].cast("int")
        small = _uint(header, at + 1, 4)
        wide = small == 1

        def visit(box: Column) -> Column:
            head, length = box["head"], box["length"]
            is_ftyp = box["type"] == "66747970"
            fits = (acc["pos"] + length <= size) & (length >= head + 8)
            brands = brands_of(acc["pos"] + head, (length - head).cast("bigint"))
            onward = F.struct(
                F.least(acc["pos"] + length, F.lit(1 << 40)).cast("bigint").alias("pos"),
                nothing.alias("brands"),
                F.lit(False).alias("done"),
            )
            return (
                F.when(length < head, finish(nothing))
                .when(is_ftyp & fits, finish(brands))
                .when(is_ftyp, finish(nothing))
                .otherwise(onward)
            )

        box = F.struct(
            F.when(wide, 16).otherwise(8).cast("bigint").alias("head"),
            F.when(wide, _uint(header, at + 9, 8)).otherwise(small).alias("length"),
            F.hex(F.substring(header, at + 5, F.lit(4))).alias("type"),
        )
        return (
            F.when(acc["done"], acc)
            .when(acc["pos"] + 8 > size, finish(nothing))
            .when(wide & (acc["pos"] + 16 > size), finish(nothing))
            .otherwise(let(box, visit))
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("pos"), nothing.alias("brands"), F.lit(False).alias("done")
    ).cast(state)
    steps = F.sequence(F.lit(1), F.greatest(F.floor(size / 8), F.lit(1)).cast("int"))
    return F.aggregate(steps, start, lambda a, i: step(a, i).cast(state))["brands"]


def _vint_length(data: Column, at: Column) -> Column:
    """Bytes of the EBML number at 1-based `at`: one more than its leading zero bits."""
    first = _uint(data, at, 1).cast("int")
    return F.when(first > 0, F.lit(9) - F.length(F.bin(first)))


def _vint_size(data: Column, at: Column, length: Column) -> Column:
    """Value of an EBML size with its marker bit removed; all ones means unknown, so null."""
    raw = _uint(data, at, length)
    limit = F.pow(F.lit(2.0), length * 7).cast("decimal(20,0)")
    value = raw - limit
    return F.when(value != limit - 1, value)


def ebml_document_type(header: Column) -> Column:
    """DocType of one complete EBML header: `matroska`, `webm` or null.

    Null for truncated, unknown-size, overrunning or repeated elements.
    """
    total = F.length(header)
    size_bytes = _vint_length(header, F.lit(5))
    head_size = F.when(total >= 4 + size_bytes, _vint_size(header, F.lit(5), size_bytes))
    begin = (size_bytes + 4).cast("bigint")
    end = (begin + head_size).cast("bigint")
    state = "struct<pos:bigint,doctype:string,seen:int,bad:boolean>"

    def step(acc: Column, _: Column) -> Column:
        at = (acc["pos"] + 1).cast("int")
        bad = acc.withField("bad", F.lit(True))

        def with_id(id_bytes: Column) -> Column:
            size_at = at + id_bytes

            def with_size(sized: Column) -> Column:
                value_at = size_at + sized["bytes"]
                stop = value_at - 1 + sized["value"]
                is_doctype = F.hex(F.substring(header, at, id_bytes)) == vocab.EBML_DOCTYPE_ID
                text = F.decode(
                    F.substring(header, value_at, F.least(sized["value"], F.lit(16)).cast("int")),
                    "ISO-8859-1",
                )
                advanced = F.struct(
                    stop.cast("bigint").alias("pos"),
                    F.when(is_doctype & (sized["value"] <= 16), text)
                    .when(is_doctype, F.lit("?"))
                    .otherwise(acc["doctype"])
                    .alias("doctype"),
                    (acc["seen"] + is_doctype.cast("int")).alias("seen"),
                    F.lit(False).alias("bad"),
                )
                return F.when(sized["value"].isNull() | (stop > end), bad).otherwise(advanced)

            size_length = F.when(size_at <= total, _vint_length(header, size_at))
            sized = F.struct(
                size_length.alias("bytes"),
                F.when(
                    size_at - 1 + size_length <= total,
                    _vint_size(header, size_at, size_length),
                ).alias("value"),
            )
            unreadable = id_bytes.isNull() | (id_bytes > 4) | (at - 1 + id_bytes > total)
            return F.when(unreadable, bad).otherwise(let(sized, with_size))

        return F.when(acc["bad"] | (acc["pos"] >= end), acc).otherwise(
            let(_vint_length(header, at), with_id)
        )

    start = F.struct(
        begin.alias("pos"),
        F.lit(None).cast("string").alias("doctype"),
        F.lit(0).alias("seen"),
        F.lit(False).alias("bad"),
    ).cast(state)
    # an element takes two bytes at least
    steps = F.sequence(F.lit(1), F.greatest(F.floor(head_size / 2), F.lit(1)).cast("int"))
    readable = (F.hex(F.substring(header, 1, 4)) == vocab.EBML_MAGIC) & (end <= total)
    walked = F.aggregate(steps, start, lambda a, i: step(a, i).cast(state))
    found = let(
        walked,
        lambda w: F.when(
            ~w["bad"] & (w["seen"] == 1) & w["doctype"].isin(*vocab.EBML_DOCTYPES), w["doctype"]
        ),
    )
    return F.when(readable, found)


def classify(header: Column, *, mpeg_before_bmff: bool = True) -> Column:
    """struct(kind, document_type, brands) of the leading bytes; null kind when unknown.

    The order of the branches decides overlaps. An MPEG sync pair outranks a box header, so
    a movie whose first bytes hold such a pair is classed as `mp3`; `mpeg_before_bmff=False`
    looks for the boxes first. The header is bound once: an expression that cuts it out of the content
    would else be evaluated, and copied, at every mention and step.
    """
    return let(header, lambda bytes_: _classified(bytes_, mpeg_before_bmff))


def _classified(header: Column, mpeg_before_bmff: bool) -> Column:
    magic = F.hex(F.substring(header, 1, 12))
    riff = magic.startswith("52494646") & (F.length(header) >= 12)
    form = F.substring(magic, 17, 8)

    def record(kind: str | None, doctype: Column | None = None, brands: Column | None = None) -> Column:
        if doctype is None and brands is None:
            name = "NULL" if kind is None else f"'{kind}'"
            return F.expr(
                f"named_struct('kind', CAST({name} AS string), 'document_type', CAST(NULL AS string), "
                "'brands', CAST(NULL AS array<string>))"
            )
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(None) if doctype is None else doctype).cast("string").alias("document_type"),
            (F.lit(None) if brands is None else brands).cast("array<string>").alias("brands"),
        )

    def boxes(otherwise: Column) -> Column:
        return let(
            iso_bmff_brands(header),
            lambda b: F.when(b.isNotNull(), record("isobmff", brands=b)).otherwise(otherwise),
        )

    is_mpeg = magic.startswith("494433") | has_mpeg_audio_frame(header)
    if mpeg_before_bmff:
        rest = F.when(is_mpeg, record("mp3")).otherwise(boxes(record(None)))
    else:
        rest = boxes(F.when(is_mpeg, record("mp3")).otherwise(record(None)))
    ebml = let(
        ebml_document_type(header),
        lambda d: F.when(d.isNotNull(), record("matroska", doctype=d)).otherwise(record(None)),
    )
    return (
        F.when(header.isNull(), record(None))
        .when(magic.startswith("FFD8FF"), record("jpeg"))
        .when(magic.startswith("89504E470D0A1A0A"), record("png"))
        .when(riff & (form == "57454250"), record("webp"))
        .when(riff & (form == "57415645"), record("wav"))
        .when(riff & (form == "41564920"), record("avi"))
        .when(riff, record(None))
        .when(magic.startswith("664C6143"), record("flac"))
        .when(magic.startswith(vocab.EBML_MAGIC), ebml)
        .otherwise(rest)
    )
