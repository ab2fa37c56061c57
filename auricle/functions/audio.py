"""Byte-level column functions on audio content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File signatures (offset, bytes, label), tried in this order.
SIGNATURES = (
    (0, "52494646", "wav"),
    (0, "494433", "mp3"),
    (0, "664C6143", "flac"),
    (0, "4F676753", "ogg"),
    (0, "1A45DFA3", "webm"),
    (4, "66747970", "m4a/mp4"),
)
DECODED_BYTE_CAP = 25 * 2**20
MIN_SAMPLES = 1_600
MAX_PAYLOAD_SAMPLES = 9_600_000


def _byte(content: Column, at: int) -> Column:
    """Unsigned byte; 0 past the end."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(content, at + 1, 1)), F.lit("")), 16, 10).cast("int"), F.lit(0))


def _bits(byte: Column, shift: int, mask: int) -> Column:
    return F.shiftright(byte, shift).bitwiseAND(F.lit(mask))


def sniff_format(content: Column) -> Column:
    """Format label by signature, then MPEG frame sync, then ADTS sync; null if unknown, null content included."""
    label = F.when(F.lit(False), F.lit(""))
    for at, magic, name in SIGNATURES:
        label = label.when(F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic, F.lit(name))
    b0, b1, b2 = (_byte(content, i) for i in range(3))
    long_enough = F.length(content) >= 4
    mpeg = (b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xE0)) == 0xE0) & (_bits(b1, 3, 3) != 1) & (_bits(b1, 1, 3) != 0) & (_bits(b2, 4, 15) != 15) & (_bits(b2, 2, 3) != 3)
    adts = (b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xF0)) == 0xF0) & (_bits(b2, 6, 3) != 3)
    return label.when(long_enough & mpeg, F.lit("mp3")).when(long_enough & adts, F.lit("aac"))


def clip_duration(n_samples: Column, sample_rate: Column | int) -> Column:
    """Seconds as 32-bit float; null for a rate of zero."""
    rate = F.lit(sample_rate) if isinstance(sample_rate, int) else sample_rate
    return F.try_divide(n_samples.cast("float"), rate.cast("float")).cast("float")


def fixed_decimals(value: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, halves to even, as ``%.Nf`` prints it."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


#: Chunks of a RIFF file that are walked before the walk is sized to the file.
FIRST_CHUNKS = 32
SAMPLE_RATE = 16_000


def little_endian(content: Column, at: Column, size: int) -> Column:
    """Unsigned number of ``size`` bytes from byte ``at``; null if they are not all there."""
    digits = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, 10).cast("bigint"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walk(content: Column, steps: Column) -> Column:
    """State after so many chunks: (at, good, found, start, size), ``found`` once the data chunk is met or no chunk is left."""
    length = F.length(content).cast("bigint")
    state = lambda at, good, found, start, size: F.struct(at.alias("at"), good.alias("good"), found.alias("found"), start.alias("start"), size.alias("size"))
    none = F.lit(None).cast("bigint")

    def chunk(s: Column, head: Column) -> Column:
        """The state after a chunk whose eight bytes of name and size are given in hexadecimal digits."""
        name, body = F.substring(head, 1, 8), s["at"] + 8
        size = F.conv(F.concat(*[F.substring(head, i, 2) for i in (15, 13, 11, 9)]), 16, 10).cast("bigint")
        number = lambda offset, n: little_endian(content, body + offset, n)
        fits = (number(0, 2) == 1) & (number(2, 2) == 1) & (number(4, 4) == SAMPLE_RATE) & (number(14, 2) == 16)

        def after(n: Column) -> Column:
            is_format = (name == "666D7420") & (F.least(n, length - body) >= 16)  # "fmt "
            data = state(s["at"], s["good"], F.lit(True), body, F.least(n, length - body))
            # a size may point far beyond the file, whose end is then the next chunk's place
            return F.when(name == "64617461", data).otherwise(state(F.least(body + n + n % 2, length), F.when(is_format, fits).otherwise(s["good"]), F.lit(False), none, none))

        return _let(size, after)

    def step(s: Column, _: Column) -> Column:
        ended = state(s["at"], s["good"], F.lit(True), none, none)
        head = F.hex(F.substring(content, s["at"].cast("int") + 1, F.lit(8)))
        return F.when(s["found"], s).when(s["at"] + 8 > length, ended).otherwise(_let(head, lambda h: chunk(s, h)))

    first = state(F.lit(12).cast("bigint"), F.lit(False), F.lit(False), none, none)
    return F.aggregate(F.sequence(F.lit(1), steps), first, step)


def wav_data(content: Column) -> Column:
    """struct(start, size) of the sample bytes of a RIFF clip of 16-bit mono PCM at 16 kHz; null for any other content.

    The chunks are walked to the first one with data, over any others, padded to even sizes; a clip cut short
    has what is there. A file with more than FIRST_CHUNKS before its data is walked again with room for all it can hold.
    """
    riff = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645")
    all_of_them = _walk(content, (F.length(content) / 8).cast("int") + 1)
    walked = _let(_walk(content, F.lit(FIRST_CHUNKS)), lambda few: F.when(few["found"], few).otherwise(all_of_them))
    place = lambda w: F.when(w["good"] & w["start"].isNotNull(), F.struct(w["start"].alias("start"), w["size"].alias("size")))
    return F.when(riff, _let(walked, place))


def wav_pcm(content: Column) -> Column:
    """The sample bytes that ``wav_data`` finds."""
    return _let(wav_data(content), lambda d: F.when(d.isNotNull(), F.substring(content, d["start"].cast("int") + 1, d["size"].cast("int"))))


def wav_sample_count(content: Column) -> Column:
    """Samples of a clip by the size of its data, without reading them."""
    return F.floor(wav_data(content)["size"] / 2).cast("bigint")
