"""M1-M6: audio and image-size operators over arrays and sizes of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foldwise.catalog.registry import query, rounded, table
from foldwise.operators.media import (
    first_segment, image_sizes, load_waveforms, mel_spectrogram, resample, segments, size_ratio_warnings,
)


def _waves(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("waveform"))


def _total(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _big_endian(value: Column, size: int) -> Column:
    """Hexadecimal digits of an unsigned integer, highest byte first."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def _image_bytes(kind: Column, width: Column, height: Column) -> Column:
    """Headers of a PNG with alpha, a JPEG, a BMP and TIFF files in both byte orders, by ``kind``."""
    big, little = _big_endian, _little_endian
    chunk = F.concat(F.hex(F.lit("IHDR")), big(width, 4), big(height, 4), F.lit("0806000000"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), chunk, big(F.crc32(F.unhex(chunk)), 4))
    frame = F.concat(F.lit("FFC0001108"), big(height, 2), big(width, 2), F.lit("03012200021101031101"))
    jpeg = F.concat(F.lit("FFD8" + "FFE000104A46494600010100000100010000" + "FFFE00046869"), frame)
    bmp = F.concat(
        F.hex(F.lit("BM")), F.lit("00" * 12), little(F.lit(40), 4), little(width, 4), little(height, 4),
        F.lit("01001800"), F.lit("00" * 24),
    )

    def tiff(lead: str, number) -> Column:
        entry = lambda tag, value: F.concat(number(F.lit(tag), 2), number(F.lit(4), 2), number(F.lit(1), 4), number(value, 4))
        fields = [entry(256, width), entry(257, height), entry(258, F.lit(8)), entry(262, F.lit(1)), entry(277, F.lit(1))]
        return F.concat(F.lit(lead), number(F.lit(8), 4), number(F.lit(5), 2), *fields, F.lit("00000000"))

    found = F.when(kind == 0, png).when(kind == 1, jpeg).when(kind == 2, bmp)
    return F.unhex(found.when(kind == 3, tiff("49492A00", little)).otherwise(tiff("4D4D002A", big)))


@query(
    "m1_image_sizes",
    """WITH k AS (SELECT doc_id, doc_id % 5 AS kind, n_chars % 60000 + 1 AS w, doc_id % 3000 + 1 AS h, doc_id % 7 = 0 AS cut
                  FROM documents)
       SELECT doc_id, CAST(CASE WHEN cut THEN 0 ELSE w END AS INTEGER) AS width,
         CAST(CASE WHEN cut THEN 0 ELSE h END AS INTEGER) AS height,
         CASE WHEN cut THEN 0 WHEN kind = 0 THEN 4 WHEN kind < 3 THEN 3 ELSE 1 END AS channels FROM k""",
)
def _sizes(spark, d):
    """Files made from the documents' numbers, every seventh one cut inside its header."""
    width, height = F.col("n_chars") % 60000 + 1, F.col("doc_id") % 3000 + 1
    whole = _image_bytes(F.col("doc_id") % 5, width, height)
    content = F.when(F.col("doc_id") % 7 == 0, F.substring(whole, 1, 22)).otherwise(whole)
    found = image_sizes(table(spark, d, "documents").select("doc_id", content.alias("content")), "content")
    return found.select(
        "doc_id", F.col("__image_width__").alias("width"), F.col("__image_height__").alias("height"),
        F.col("__image_channels__").alias("channels"),
    )


@query(
    "m2_size_ratio",
    """SELECT doc_id, round(n_chars / 1000.0::DOUBLE, 6) AS size_ratio FROM documents
       WHERE n_chars / 1000.0::DOUBLE > 4 OR n_chars / 1000.0::DOUBLE < 0.25""",
)
def _ratio(spark, d):
    sizes = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("w"), F.lit(1).alias("h"))
    return rounded(size_ratio_warnings(sizes, "w", "h", 1000).select("doc_id", "size_ratio"), 6, "size_ratio")


def _little_endian(value: Column, size: int) -> Column:
    """Hexadecimal digits of an unsigned integer, lowest byte first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _wav_bytes(samples: Column, rate: int) -> Column:
    """A mono 16-bit WAV file of an array of samples in [-1, 1]."""
    size = F.array_size(samples) * 2
    head = [
        F.hex(F.lit("RIFF")), _little_endian(size + 36, 4), F.hex(F.lit("WAVEfmt ")),
        _little_endian(F.lit(16), 4), _little_endian(F.lit(1), 2), _little_endian(F.lit(1), 2),
        _little_endian(F.lit(rate), 4), _little_endian(F.lit(2 * rate), 4),
        _little_endian(F.lit(2), 2), _little_endian(F.lit(16), 2),
        F.hex(F.lit("data")), _little_endian(size, 4),
    ]
    whole = F.transform(
        samples, lambda x: F.floor(x.cast("double") * 32767).bitwiseAND(F.lit(65535).cast("long"))
    )
    body = F.array_join(F.transform(whole, lambda v: _little_endian(v, 2)), "")
    return F.unhex(F.concat(*head, body))


@query(
    "m3_load_waveforms",
    """SELECT 'v' || vec_id AS path, 100 AS sample_rate, round(len(embedding) / 100.0::DOUBLE, 6) AS seconds,
              round(list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 32767) / 32768)), 4) AS total
       FROM embeddings""",
)
def _load(spark, d):
    files = _waves(spark, d).select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("path"),
        _wav_bytes(F.col("waveform"), 100).alias("content"),
    )
    return load_waveforms(files).select(
        "path", "sample_rate", F.round("duration_seconds", 6).alias("seconds"),
        F.round(_total("waveform"), 4).alias("total"),
    )


@query(
    "m4_resample",
    """WITH c AS (SELECT vec_id, embedding AS e, len(embedding) AS n, CAST(floor(len(embedding) * 0.75) AS BIGINT) AS size
                  FROM embeddings),
       s AS (SELECT vec_id, e, n, unnest(range(size)) AS i, size FROM c),
       p AS (SELECT vec_id, e, n, greatest(0.0, least(n - 1.0, (i + 0.5) * n / size - 0.5)) AS x FROM s)
       SELECT vec_id, count(*) AS n,
              round(sum(e[CAST(floor(x) AS BIGINT) + 1]::DOUBLE * (1 - (x - floor(x)))
                        + e[least(CAST(floor(x) AS BIGINT) + 2, n)]::DOUBLE * (x - floor(x))), 4) AS total
       FROM p GROUP BY 1""",
)
def _resampled(spark, d):
    waves = resample(_waves(spark, d).withColumn("rate", F.lit(64)), "waveform", "rate", 48)
    return waves.select(
        "vec_id", F.array_size("waveform").cast("long").alias("n"), F.round(_total("waveform"), 4).alias("total")
    )


@query(
    "m5_segments",
    """WITH s AS (SELECT vec_id, embedding AS e, unnest(range(0, len(embedding), 24)) AS a FROM embeddings)
       SELECT vec_id, CAST(a // 24 AS INTEGER) AS segment, 24 AS n,
              round(list_sum(list_transform(e[a + 1:a + 24], lambda x: x::DOUBLE)), 6) AS total FROM s""",
)
def _segments(spark, d):
    cut = segments(_waves(spark, d), "waveform", 24)
    return cut.select(
        "vec_id", "segment", F.array_size("waveform").alias("n"), F.round(_total("waveform"), 6).alias("total")
    )


@query(
    "m5_first_segment",
    """SELECT vec_id, 100 AS n, round(list_sum(list_transform(embedding[1:100], lambda x: x::DOUBLE)), 6) AS total
       FROM embeddings""",
)
def _first(spark, d):
    cut = first_segment(_waves(spark, d), "waveform", 100)
    return cut.select("vec_id", F.array_size("waveform").alias("n"), F.round(_total("waveform"), 6).alias("total"))


@query(
    "m6_mel_spectrogram",
    """WITH s AS (SELECT vec_id, a // 32 AS segment, list_resize(e[a + 1:a + 32], 32, 0.0) AS x
                  FROM (SELECT vec_id, embedding AS e, unnest(range(0, len(embedding), 32)) AS a FROM embeddings)),
       f AS (SELECT vec_id, segment, x, unnest(range(5)) AS frame FROM s),
       i AS (SELECT *, unnest(range(16)) AS i FROM f),
       r AS (SELECT *, abs(frame * 8 + i - 8) AS j FROM i),
       v AS (SELECT vec_id, segment, frame, i,
               x[CAST(CASE WHEN j > 31 THEN 62 - j ELSE j END AS BIGINT) + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS v FROM r),
       p AS (SELECT vec_id, segment, frame, b,
               pow(sum(v * cos(2 * pi() * b * i / 16)), 2) + pow(sum(v * sin(2 * pi() * b * i / 16)), 2) AS power
             FROM v, range(9) AS bins(b) GROUP BY ALL),
       e AS (SELECT m, floor(17 * 700.0::DOUBLE * (pow(10::DOUBLE, m / 5.0::DOUBLE * log10(1 + 32 / 700.0::DOUBLE)) - 1) / 64) AS edge
             FROM range(6) AS marks(m)),
       w AS (SELECT l.m AS band, b, CAST(CASE
               WHEN b >= l.edge AND b < c.edge THEN (b - l.edge) / greatest(c.edge - l.edge, 1)
               WHEN b >= c.edge AND b < h.edge THEN (h.edge - b) / greatest(h.edge - c.edge, 1) ELSE 0 END AS FLOAT)::DOUBLE AS weight
             FROM e l JOIN e c ON c.m = l.m + 1 JOIN e h ON h.m = l.m + 2, range(9) AS bins(b)),
       d AS (SELECT vec_id, segment, band, frame, 10 * log10(greatest(sum(power * weight), 1e-10)) AS db
             FROM p JOIN w USING (b) GROUP BY ALL),
       t AS (SELECT *, max(db) OVER (PARTITION BY vec_id, segment) - 80 AS least FROM d)
       SELECT vec_id, CAST(segment AS INTEGER) AS segment, CAST(band AS INTEGER) AS band, CAST(frame AS INTEGER) AS frame,
         round(CAST(greatest(db, least) AS FLOAT)::DOUBLE, 2) AS decibels FROM t""",
)
def _mel(spark, d):
    mel = mel_spectrogram(
        segments(_waves(spark, d), "waveform", 32), "waveform", "mel_db",
        sample_rate=64, n_fft=16, hop_length=8, n_mels=4,
    )
    bands = mel.select("vec_id", "segment", F.posexplode("mel_db").alias("band", "levels"))
    frames = bands.select("vec_id", "segment", "band", F.posexplode("levels").alias("frame", "level"))
    return frames.select(
        "vec_id", "segment", "band", "frame", F.round(F.col("level").cast("double"), 2).alias("decibels")
    )
