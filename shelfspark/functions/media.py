"""Column functions on names, paths, identities and times of media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media extensions by kind.
VIDEO = "mp4 mkv avi mov wmv flv webm m4v mpg mpeg m2ts mts 3gp vob rmvb rm ogv divx asf f4v m2v mpv".split()
IMAGE = "jpg jpeg jfif png gif bmp webp tif tiff heic heif avif ico svg psd raw cr2 cr3 nef arw dng orf rw2 raf sr2".split()
AUDIO = "mp3 flac wav aac ogg oga m4a m4b wma opus aiff aif ape alac ac3 dts dsf dff mka amr mid midi wv tta".split()
KINDS = ("video", "image", "audio")

# Directory names that are skipped with everything beneath them.
EXCLUDED = [
    "windows", "windows.old", "winsxs", "$recycle.bin", "$winreagent", "system volume information", "recovery", "programdata", "appdata",
    "program files", "program files (x86)", "perflogs", "msocache", "$sysreset", "node_modules", "bower_components", "__pycache__", "site-packages",
]

# Content types by extension.
CONTENT_TYPES = {
    "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "png": "image/png", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "bmp": "image/bmp", "mp3": "audio/mpeg",
    "m4a": "audio/mp4", "aac": "audio/mp4", "wav": "audio/wav", "ogg": "audio/ogg", "opus": "audio/ogg", "flac": "audio/flac",
}

ROOT = 5
RECORD_MASK = 0x0000FFFFFFFFFFFF
#: 100 ns steps between 1601 and 1970.
EPOCH_TICKS = 116_444_736_000_000_000


def media_kind(name: Column) -> Column:
    """video, image or audio by the extension (1 to 5 ASCII characters after the last dot); else null."""
    ext = F.lower(F.regexp_extract(name, r"\.([\x00-\x2D\x2F-\x7F]{1,5})$", 1))
    return F.when(ext.isin(VIDEO), "video").when(ext.isin(IMAGE), "image").when(ext.isin(AUDIO), "audio")


def report_extension(name: Column) -> Column:
    """Lower-cased text after the last dot; '' without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def content_type(name: Column) -> Column:
    by_ext = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(by_ext, report_extension(name)), F.lit("application/octet-stream"))


def full_path(dir_path: Column, name: Column) -> Column:
    return F.concat(dir_path, F.lit("\\"), name)


def volume_of(path: Column) -> Column:
    return F.upper(F.substring(path, 1, 1))


def record_number(frn: Column) -> Column:
    return frn.bitwiseAND(F.lit(RECORD_MASK))


def lookup_frn(frn: Column) -> Column:
    """Every form of the root's identity as ROOT."""
    return F.when(record_number(frn) == ROOT, F.lit(ROOT).cast("long")).otherwise(frn)


def excluded_component(name: Column, skip_dot: bool = True, names: list[str] = EXCLUDED) -> Column:
    listed = F.lower(name).isin([n.lower() for n in names])
    return listed | name.startswith(".") if skip_dot else listed


def excluded_path(path: Column, skip_dot: bool = True, names: list[str] = EXCLUDED) -> Column:
    """Does any directory below the drive have an excluded name?"""
    parts = F.split(path, "\\\\")
    return F.exists(F.slice(parts, 2, F.size(parts)), lambda c: excluded_component(c, skip_dot, names))


def is_under(path: Column, folder: Column) -> Column:
    """Strictly below the folder, ignoring case."""
    return F.startswith(F.lower(path), F.concat(F.lower(folder), F.lit("\\")))


def rewrite_prefix(path: Column, old: Column, new: Column) -> Column:
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def strip_extended_prefix(path: Column) -> Column:
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "\\\\")) - 1


def top_root(path: Column) -> Column:
    """Drive and first folder."""
    return F.substring_index(path, "\\", 2)


def path_key(path: Column) -> Column:
    """Identity of a path whatever its case."""
    return F.lower(path)


def filetime_to_unix(ticks: Column) -> Column:
    return F.greatest(F.expr("0L"), F.floor((ticks - EPOCH_TICKS) / 10_000_000)).cast("long")


def filetime_hour(ticks: Column) -> Column:
    """UTC day and hour, ``2024-02-29 00h``; ? for no time."""
    stamp = F.timestamp_seconds(F.floor((ticks - EPOCH_TICKS) / 10_000_000).cast("long"))
    return F.when(ticks > 0, F.date_format(stamp, "yyyy-MM-dd HH'h'")).otherwise(F.lit("?"))


def props_empty(width: Column, height: Column, duration_ms: Column) -> Column:
    return (width == 0) & (height == 0) & (duration_ms == 0)


#: Bytes at each end of a file that a fingerprint covers.
EDGE = 65_536


def sample_fingerprint(content: Column, size: Column, edge: int = EDGE) -> Column:
    """Digest of the whole of a small file, or of its first and last ``edge`` bytes; compare together with size."""
    ends = F.concat(F.substring(content, 1, edge), F.substring(content, -edge, edge))
    return F.sha2(F.when(size <= 2 * edge, content).otherwise(ends), 256)


def full_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def resolution_label(width: Column, height: Column) -> Column:
    short = F.least(width, height)
    label = F.when((width == 0) | (height == 0), "").when(short >= 2160, "4K")
    for lines in (1440, 1080, 720, 480):
        label = label.when(short >= lines, f"{lines}p")
    return label.otherwise(F.concat(width.cast("string"), F.lit("×"), height.cast("string")))


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.2f", n / float(1024**4)), F.lit(" TB")))


def human_duration(ms: Column) -> Column:
    total = F.floor(ms / 1000 + F.lit(0.5)).cast("long")
    h, m, s = F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60
    return F.when(ms == 0, "").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def count_label(n: Column, mark: str = ".") -> Column:
    """``1.234.567``: a whole number in groups of three digits."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(mark))


def time_label(unix: Column) -> Column:
    """``14:05:09 1/2/2024`` in the session's time zone; empty for no time."""
    return F.when(F.coalesce(unix, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(unix), "HH:mm:ss d/M/yyyy"))


def byte_range(header: Column, size: Column, cap: int = 8 << 20) -> Column:
    """First and last byte (inclusive) of a single-range header, clamped and capped; null if it cannot be served."""
    first, last = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k) for k in (1, 2))
    valid = header.rlike(r"^bytes=\d*-\d*$") & ((first != "") | (last != "")) & (size > 0)
    number = lambda c: F.try_to_number(c, F.lit("9" * 18)).cast("long")
    start = F.when(first == "", F.greatest(size - number(last), F.lit(0))).otherwise(number(first))
    stop = F.when((first == "") | (last == ""), size - 1).otherwise(F.least(number(last), size - 1))
    served = valid & (start < size) & (start <= stop) & ((first != "") | (number(last) > 0))
    return F.when(served, F.struct(start.alias("first"), F.least(stop, start + cap - 1).alias("last")))


def slice_bytes(content: Column, wanted: Column) -> Column:
    """The bytes of a :func:`byte_range`."""
    return F.substring(content, wanted["first"] + 1, wanted["last"] - wanted["first"] + 1)


def entry_handle(handle: Column) -> Column:
    """``{epoch}_{index}`` as a struct; null if malformed."""
    part = lambda k: F.regexp_extract(handle, r"^(\d{1,18})_(\d{1,18})$", k)
    return F.when(part(1) != "", F.struct(F.try_to_number(part(1), F.lit("9" * 18)).cast("long").alias("epoch"), F.try_to_number(part(2), F.lit("9" * 18)).cast("long").alias("index")))


def thumbnail_size(size: Column, default: int = 192) -> Column:
    return F.greatest(F.lit(16), F.least(F.lit(512), F.coalesce(size, F.lit(default))))


def describe_change(op: Column, volume: Column, name: Column, is_dir: Column) -> Column:
    what = F.when(is_dir, "directory").otherwise("file")
    return F.when(op == "gone", F.concat(volume, F.lit(": gone"))).otherwise(F.concat(volume, F.lit(": present "), what, F.lit(" "), name))
