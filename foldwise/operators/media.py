"""Image metadata and audio features as Spark jobs.

Spark lists, partitions and shuffles; Python only decodes sound files and
transforms stacks of segments with numpy.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foldwise.functions.images import image_size

# Image suffixes, mel scale and decibel range.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff")
MEL_FACTOR, MEL_BREAK_HZ = 2595.0, 700.0
POWER_FLOOR, TOP_DB = 1e-10, 80.0
MIN_SIZE_RATIO, MAX_SIZE_RATIO = 0.25, 4.0

# Decoded samples a task holds before it hands them on; long files go one by one.
HELD_SAMPLES = 4_000_000


def plain_path(path: Column) -> Column:
    """A local file URI as a path; other schemes stay as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def list_images(spark: SparkSession, directory: str) -> DataFrame:
    """Sorted ``path`` of the image files in a directory; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{" + ",".join(IMAGE_SUFFIXES) + "}")
        .load(directory)
    )
    return files.select(plain_path(F.col("path")).alias("path")).orderBy("path")


SIZE_COLUMNS = {"__image_width__": "width", "__image_height__": "height", "__image_channels__": "channels"}


def image_sizes(df: DataFrame, content_col: str) -> DataFrame:
    """Width, height and channels of image files' bytes, from their headers (M1).

    Grey images have 1 channel, those with red, green, blue and alpha 4, all others 3.
    0 where there is no image, its header is cut or broken, or the bytes are NULL.
    """
    found = df.withColumn("__size", image_size(F.col(content_col)))
    sized = {out: F.coalesce(F.col("__size")[part], F.lit(0)) for out, part in SIZE_COLUMNS.items()}
    return found.withColumns(sized).drop("__size")


def image_metadata(df: DataFrame, path_col: str, directory: str) -> DataFrame:
    """Width, height and channels per row; 0 for an unreadable or unknown file (M1).

    Only headers are looked at; file contents are not shuffled.
    """
    files = df.sparkSession.read.format("binaryFile").load(directory)
    known = image_sizes(files.select(plain_path(F.col("path")).alias("__path"), "content"), "content").drop("content")
    joined = df.join(known, F.col(path_col) == F.col("__path"), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in SIZE_COLUMNS}).drop("__path")


def size_ratio_warnings(
    df: DataFrame, width_col: str, height_col: str, expected: int
) -> DataFrame:
    """Rows whose larger side is far from the expected size, with the ratio (M2)."""
    ratio = F.greatest(F.col(width_col), F.col(height_col)) / F.lit(float(expected))
    return df.withColumn("size_ratio", ratio).where(
        (F.col("size_ratio") > MAX_SIZE_RATIO) | (F.col("size_ratio") < MIN_SIZE_RATIO)
    )


def _pcm_samples(raw: bytes, width: int) -> np.ndarray:
    """Signed little-endian PCM of 1-4 bytes as floats in [-1, 1)."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    if width == 3:
        padded = np.zeros((len(raw) // 3, 4), np.uint8)
        padded[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return padded.view("<i4").ravel().astype(np.float64) / 2.0**31
    kind = {2: "<i2", 4: "<i4"}[width]
    return np.frombuffer(raw, kind).astype(np.float64) / 2.0 ** (8 * width - 1)


def load_waveforms(df: DataFrame, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """Decode (path, content) rows of PCM WAV to mono waveforms (M3).

    ``offset`` and ``duration`` are seconds; channels are averaged.  Batches
    of files are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """

    names = ["path", "waveform", "sample_rate", "duration_seconds"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as f:
                    rate, channels = f.getframerate(), f.getnchannels()
                    start = min(int(offset * rate), f.getnframes())
                    wanted = f.getnframes() - start
                    if duration is not None and int(duration * rate) > 0:
                        wanted = min(wanted, int(duration * rate))
                    f.setpos(start)
                    samples = _pcm_samples(f.readframes(wanted), f.getsampwidth())
                mono = samples.reshape(-1, channels).mean(axis=1).astype(np.float32)
                rows.append((path, mono, rate, len(mono) / rate))
                held += len(mono)
                if held > HELD_SAMPLES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    schema = "path string, waveform array<float>, sample_rate int, duration_seconds double"
    return df.select("path", "content").mapInPandas(decode, schema)


def resample(df: DataFrame, waveform_col: str, rate_col: str, target_rate: int) -> DataFrame:
    """Linear resampling to ``target_rate``, sample centres aligned (M4).

    Each new sample lies between two neighbours, or is the first or last one.
    """
    old = F.col(waveform_col)
    n, rate = F.array_size(old), F.col(rate_col)
    size = F.floor(n * (F.lit(float(target_rate)) / rate)).cast("int")

    def sample(i: Column) -> Column:
        centre = (i + 0.5) * (n / size) - 0.5
        place = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), centre))
        left = F.floor(place).cast("int")
        low = F.get(old, left).cast("double")
        high = F.get(old, F.least(left + 1, n - 1)).cast("double")
        return (low + (high - low) * (place - left)).cast("float")

    new = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), sample))
    empty = F.array().cast("array<float>")
    resampled = F.when(rate == target_rate, old).when(old.isNotNull(), F.coalesce(new, empty))
    return df.withColumn(waveform_col, resampled.cast("array<float>"))


def _padded(samples: Column, length: int) -> Column:
    """First ``length`` samples, zeros after the end."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), length)
    return F.slice(F.concat(samples, zeros), 1, length)


def first_segment(df: DataFrame, waveform_col: str, samples: int) -> DataFrame:
    """Cut or zero-pad each waveform to one fixed length (M5)."""
    return df.withColumn(waveform_col, _padded(F.col(waveform_col), samples))


def segments(
    df: DataFrame, waveform_col: str, samples: int, index_col: str = "segment"
) -> DataFrame:
    """One row per fixed-length segment, the last one zero-padded (M5)."""
    size = F.array_size(waveform_col)
    starts = F.when(size > 0, F.sequence(F.lit(1), size, F.lit(samples))).otherwise(
        F.array().cast("array<int>")
    )
    others = [c for c in df.columns if c != waveform_col]
    cut = F.slice(F.col(waveform_col), F.col("__start"), F.lit(samples))
    return df.select("*", F.posexplode(starts).alias(index_col, "__start")).select(
        *others, index_col, _padded(cut, samples).alias(waveform_col)
    )


@lru_cache(maxsize=8)
def mel_filters(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular mel filters, (n_mels, n_fft // 2 + 1); one copy per worker."""
    top = MEL_FACTOR * np.log10(1.0 + rate / 2 / MEL_BREAK_HZ)
    hertz = MEL_BREAK_HZ * (10.0 ** (np.linspace(0.0, top, n_mels + 2) / MEL_FACTOR) - 1.0)
    edges = np.floor((n_fft + 1) * hertz / rate)
    low, mid, high = (e[:, None] for e in (edges[:-2], edges[1:-1], edges[2:]))
    bins = np.arange(n_fft // 2 + 1)[None, :]
    rising = (bins - low) / np.maximum(mid - low, 1.0)
    falling = (high - bins) / np.maximum(high - mid, 1.0)
    up, down = (bins >= low) & (bins < mid), (bins >= mid) & (bins < high)
    return np.where(up, rising, np.where(down, falling, 0.0)).astype(np.float32)


def mel_decibels(samples: np.ndarray, rate: int, n_fft: int, hop: int, n_mels: int) -> np.ndarray:
    """Mel power spectrograms in dB of equally long segments, floored 80 dB below each one's peak.

    ``samples`` is (..., length); one transform and one filter product serve all of them.
    """
    window = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / n_fft)
    edge = [(0, 0)] * (np.ndim(samples) - 1) + [(n_fft // 2, n_fft // 2)]
    centred = np.pad(np.asarray(samples, np.float64), edge, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(centred, n_fft, axis=-1)[..., ::hop, :]
    power = np.abs(np.fft.rfft(frames * window, axis=-1)) ** 2
    mel = np.swapaxes(power @ mel_filters(rate, n_fft, n_mels).T, -1, -2)
    decibels = 10.0 * np.log10(np.maximum(mel, POWER_FLOOR))
    return np.maximum(decibels, decibels.max(axis=(-2, -1), keepdims=True) - TOP_DB).astype(np.float32)


def mel_spectrogram(
    df: DataFrame,
    waveform_col: str,
    output_col: str = "mel_db",
    sample_rate: int = 32000,
    n_fft: int = 2048,
    hop_length: int = 512,
    n_mels: int = 128,
) -> DataFrame:
    """(n_mels x frames) decibel matrix of each segment (M6).

    Segments of one length in a batch are stacked and transformed together, as
    many at a time as hold about ``HELD_SAMPLES`` samples of frames.  NULL stays NULL.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def to_mel(waves: pd.Series) -> pd.Series:
        lengths = waves.map(len, na_action="ignore")
        found: list = [None] * len(waves)
        for length in lengths.dropna().unique():
            which = np.flatnonzero(lengths == length)
            step = max(1, int(HELD_SAMPLES * hop_length // (n_fft * (length + n_fft))))
            for a in range(0, len(which), step):
                at = which[a : a + step]
                stacked = np.stack([waves.iloc[i] for i in at])
                for i, matrix in zip(at, mel_decibels(stacked, sample_rate, n_fft, hop_length, n_mels)):
                    found[i] = list(matrix)
        return pd.Series(found)

    return df.withColumn(output_col, to_mel(F.col(waveform_col)))
