"""Content pipelines: a filter language, matching of objects to pipelines, and steps as plans over all objects at once.

An object is (key, bucket, content, size, content_type, metadata: map<string, string>). A plugin is a function of the
object's columns that gives Result columns; a step is a projection, so a pipeline of any length is one pass over the
objects. Plugins that need more than columns (pixels, networks) take a DataFrame function instead (`transform`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import directory, is_text, mask_pii

_UNITS = {"": 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
_TOKEN = re.compile(r"""\s*(?:(?P<quoted>'[^']*'|"[^"]*")|(?P<op><=|>=|==|!=|=|<|>)|(?P<paren>[()])|(?P<word>[^\s()'"<>=!]+))""")


class FilterError(ValueError):
    pass


def parse_filter(text: str) -> list:
    """The filter as nested lists: ["and" | "or", left, right] or [field, operator, value]. Words are compared without case."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"can't read {text[at:]!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    place = 0

    def peek() -> tuple[str | None, str]:
        return tokens[place] if place < len(tokens) else (None, "")

    def take() -> tuple[str, str]:
        nonlocal place
        if place == len(tokens):
            raise FilterError(f"{text!r} ends early")
        place += 1
        return tokens[place - 1]

    def joined(word: str, part: Callable[[], list]) -> list:
        left = part()
        while peek()[0] == "word" and peek()[1].lower() == word:
            take()
            left = [word, left, part()]
        return left

    def clause() -> list:
        kind, name = take()
        if (kind, name) == ("paren", "("):
            inner = either()
            if take() != ("paren", ")"):
                raise FilterError(f"a ) is missing in {text!r}")
            return inner
        kind, op = take()
        op = {"==": "=", "contains": "matches"}.get(op.lower(), op.lower())
        if op not in ("=", "!=", "<", "<=", ">", ">=", "matches"):
            raise FilterError(f"{op!r} is no operator")
        kind, value = take()
        return [name, op, value[1:-1] if kind == "quoted" else value]

    def either() -> list:
        return joined("or", lambda: joined("and", clause))

    out = either()
    if place < len(tokens):
        raise FilterError(f"{tokens[place][1]!r} is left over")
    return out


def _size(value: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([KMGT]?B)?", value.upper())
    if not m:
        raise FilterError(f"{value!r} is no size")
    return int(m[1]) * _UNITS[m[2] or ""]


def condition(text: str) -> Column:
    """A filter as a column over objects; an empty one holds for all. A star at a pattern's end matches any rest; a pattern
    without one matches anywhere in the content type. Missing metadata equals nothing."""
    if not text.strip():
        return F.lit(True)

    def build(node: list) -> Column:
        head, second, third = node
        if head in ("and", "or") and isinstance(second, list):
            a, b = build(second), build(third)
            return a & b if head == "and" else a | b
        name = head.lower()
        if name == "size":
            n, s = F.lit(_size(third)), F.col("size")
            return {"<": s < n, "<=": s <= n, ">": s > n, ">=": s >= n, "=": s == n, "!=": s != n}[second]
        if name.startswith("metadata."):
            own = F.coalesce(F.try_element_at("metadata", F.lit(head[9:])), F.lit(""))
        elif name in ("content-type", "content_type"):
            own = F.lower("content_type")
            third = third.lower()
        elif name in ("key", "bucket"):
            own = F.col(name)
        else:
            raise FilterError(f"{head!r} is no field")
        if second == "matches":
            return own.startswith(third[:-1]) if third.endswith("*") else F.contains(own, F.lit(third))
        if second not in ("=", "!="):
            raise FilterError(f"{head} takes no {second}")
        return own == third if second == "=" else own != third

    return F.coalesce(build(parse_filter(text)), F.lit(False))


@dataclass
class Step:
    name: str
    plugin: str
    params: dict[str, str] = field(default_factory=dict)
    output: str = "{key}"
    inline: bool = False
    on_error: str = ""


@dataclass
class Pipeline:
    name: str
    trigger: str = "on_upload"
    filter: str = ""
    enabled: bool = True
    priority: int = 0
    steps: list[Step] = field(default_factory=list)


def load(text: str) -> list[Pipeline]:
    """Pipelines of a configuration in JSON (or YAML, where a YAML reader is installed), by priority, the highest first;
    equal ones keep their order."""
    try:
        made = json.loads(text)
    except ValueError:
        import yaml

        made = yaml.safe_load(text)
    known = Step.__dataclass_fields__
    out = [Pipeline(**{k: v for k, v in p.items() if k in Pipeline.__dataclass_fields__ and k != "steps"}, steps=[Step(**{k: v for k, v in s.items() if k in known}) for s in p.get("steps", [])]) for p in made["pipelines"]]
    return sorted(out, key=lambda p: -p.priority)


def match(objects: DataFrame, pipelines: list[Pipeline], trigger: str) -> DataFrame:
    """objects with each pipeline that is enabled, has the trigger and whose filter holds: column pipeline, and place in the
    order of the pipelines. The pipelines are a configuration of the driver's, so this is a projection and an explode."""
    able = [(i, p) for i, p in enumerate(pipelines) if p.enabled and p.trigger == trigger]
    if not able:
        return objects.where(F.lit(False)).select("*", F.lit("").alias("pipeline"), F.lit(0).alias("place"))
    each = F.array(*[F.when(condition(p.filter), F.struct(F.lit(p.name).alias("pipeline"), F.lit(i).alias("place"))) for i, p in able])
    return objects.withColumn("p", F.explode(F.array_compact(each))).select(*objects.columns, "p.pipeline", "p.place")


@dataclass
class Result:
    """What a plugin makes of an object's columns. error: null where it worked; metadata: a map; content: null where it
    gives no output; content_type of the output."""

    error: Column
    metadata: Column
    content: Column | None = None
    content_type: Column | None = None


def _map(**values: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def _only(kind: Column) -> Column:
    return F.when(~kind, F.lit("unsupported content"))


def image_compress(params: dict[str, str]) -> Result:
    return Result(_only(F.col("content_type").startswith("image/")), _map(compression="webp", quality="80"))


def image_resize(params: dict[str, str]) -> Result:
    return Result(_only(F.col("content_type").startswith("image/")), _map(resized="true"))


def video_thumbnail(params: dict[str, str]) -> Result:
    return Result(_only(F.col("content_type").startswith("video/")), _map(thumbnail_generated="true"))


def pdf_to_text(params: dict[str, str]) -> Result:
    return Result(_only(F.col("content_type") == "application/pdf"), _map(pdf_converted="true"))


def family(content_type: Column) -> Column:
    c = content_type
    return F.when(c.startswith("image/"), "image").when(c.startswith("video/"), "video").when(c.startswith("audio/"), "audio").when(c == "application/pdf", "pdf")


def metadata_extract(params: dict[str, str]) -> Result:
    f = family(F.col("content_type"))
    return Result(F.lit(None).cast("string"), F.when(f.isNotNull(), F.create_map(F.lit("extracted_from"), f)).otherwise(no_metadata()))


#: Bytes of content beyond which personal data isn't masked.
MASK_LIMIT = 50 << 20


def encrypt_pii(params: dict[str, str]) -> Result:
    """Masked personal data; an output only where something was masked; a content beyond the limit fails."""
    masked = mask_pii(F.col("content"))
    return Result(F.when(F.octet_length("content") > MASK_LIMIT, F.lit("content too large")), _map(pii_redacted="true"), F.when(masked != F.col("content"), masked), F.col("content_type"))


def vector_index(params: dict[str, str]) -> Result:
    """Marks texts as indexed; `vectors_of` makes their vectors."""
    return Result(F.lit(None).cast("string"), _map(vector_indexed="true"))


PLUGINS: dict[str, Callable[[dict[str, str]], Result]] = {f.__name__: f for f in (image_compress, image_resize, video_thumbnail, pdf_to_text, metadata_extract, encrypt_pii)}


def register(name: str, plugin: Callable[[dict[str, str]], Result], plugins: dict | None = None) -> dict:
    """A registry with the plugin in it; an equal name is replaced."""
    return {**(PLUGINS if plugins is None else plugins), name: plugin}


#: Extension of an output by its content type.
EXTENSIONS = {"text/plain": "txt", "text/html": "html", "text/css": "css", "text/csv": "csv", "application/json": "json", "application/xml": "xml", "application/pdf": "pdf", "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "video/mp4": "mp4", "audio/mpeg": "mp3"}


def output_path(pattern: str, key: Column, content_type: Column, unique: Column | None = None) -> Column:
    """A pattern with {key}, {dir} and {uuid} (eight characters; of `unique` where that is given, so that a job that runs
    again names alike) filled in, and the extension of the content type behind it."""
    ids = F.uuid() if unique is None else F.md5(unique.cast("string").cast("binary"))
    out = F.lit(pattern)
    for name, value in (("{key}", key), ("{dir}", directory(key)), ("{uuid}", F.substring(ids, 1, 8))):
        out = F.replace(out, F.lit(name), value)
    ext = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(ext.isNotNull(), F.concat(out, F.lit("."), ext)).otherwise(out)


def execute(objects: DataFrame, pipeline: Pipeline, plugins: dict | None = None) -> DataFrame:
    """key, bucket, status, error, metadata, steps (step_name, status, output_keys, error), outputs (key, content, content_type).

    Steps run in order. Their metadata is merged, later steps win. An output is kept, or with `inline` becomes what the next
    steps read. A step that fails ends the pipeline (on_error fail: failed), is left out (skip: skipped), or is noted
    (failed) and the next one runs; an unknown plugin is a failed step.
    """
    plugins = PLUGINS if plugins is None else plugins
    none, text = F.lit(None).cast("string"), "array<string>"
    df = objects.select("key", "bucket", "content", "size", "content_type", "metadata", none.alias("stop"), no_metadata().alias("made"), F.array().cast("array<struct<step_name:string,status:string,output_keys:array<string>,error:string>>").alias("steps"), F.array().cast("array<struct<key:string,content:string,content_type:string>>").alias("outputs"))
    for s in pipeline.steps:
        runs = F.col("stop").isNull()
        if s.plugin not in plugins:
            noted = F.struct(F.lit(s.name).alias("step_name"), F.lit("failed").alias("status"), F.array().cast(text).alias("output_keys"), F.lit(f"plugin not found: {s.plugin}").alias("error"))
            df = df.withColumn("steps", F.when(runs, F.array_append("steps", noted)).otherwise(F.col("steps")))
            continue
        r = plugins[s.plugin](s.params)
        content = none if r.content is None else r.content
        kind = F.coalesce(none if r.content_type is None else r.content_type, F.lit(""))
        df = df.withColumns({"__error": F.when(runs, r.error), "__made": r.metadata, "__content": F.when(runs & r.error.isNull(), content), "__kind": kind})
        worked, out = runs & F.col("__error").isNull(), F.col("__content").isNotNull()
        where = output_path(s.output, F.col("key"), F.col("__kind"), F.concat("bucket", F.lit("/"), "key", F.lit(s.name)))
        status = F.when(F.col("__error").isNull(), "completed").otherwise("skipped" if s.on_error == "skip" else "failed")
        noted = F.struct(F.lit(s.name).alias("step_name"), status.alias("status"), F.when(out, F.array(where)).otherwise(F.array().cast(text)).alias("output_keys"), F.col("__error").alias("error"))
        changes = {"steps": F.when(runs, F.array_append("steps", noted)).otherwise(F.col("steps")), "made": F.when(worked, F.map_from_entries(F.concat(F.filter(F.map_entries("made"), lambda e: ~F.array_contains(F.map_keys("__made"), e.key)), F.map_entries("__made")))).otherwise(F.col("made"))}
        if s.inline:
            changes |= {"content": F.coalesce("__content", "content"), "size": F.when(out, F.octet_length("__content")).otherwise(F.col("size")), "content_type": F.when(out & (F.col("__kind") != ""), F.col("__kind")).otherwise(F.col("content_type"))}
        else:
            changes["outputs"] = F.when(out, F.array_append("outputs", F.struct(where.alias("key"), F.col("__content").alias("content"), F.col("__kind").alias("content_type")))).otherwise(F.col("outputs"))
        if s.on_error == "fail":
            changes["stop"] = F.coalesce("stop", "__error")
        df = df.withColumns(changes).drop("__error", "__made", "__content", "__kind")
    return df.select("key", "bucket", F.when(F.col("stop").isNull(), "completed").otherwise("failed").alias("status"), F.col("stop").alias("error"), F.col("made").alias("metadata"), "steps", "outputs")


def indexable(objects: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Texts to index on upload: of a textual type, not blank, the first `most` bytes, with metadata about how."""
    c = F.col("content")
    blank = F.trim(F.regexp_replace(F.substring(c, 1, 4096), r"\s", "")) == ""
    rows = objects.where(is_text(F.col("content_type")) & F.when(blank, c.rlike(r"\S")).otherwise(True))
    head = F.when(F.octet_length(c) > most, F.try_validate_utf8(F.substring(c.cast("binary"), 1, most).cast("string"))).otherwise(c)
    more = F.create_map(F.lit("content_type"), F.col("content_type"), F.lit("indexed_by"), F.lit("auto"))
    kept = F.filter(F.map_entries("metadata"), lambda e: ~e.key.isin("content_type", "indexed_by"))
    return rows.withColumn("content", head).withColumn("metadata", F.map_from_entries(F.concat(kept, F.map_entries(more))))


#: Bounds and types of images.
MOST_PIXELS, MOST_BYTES, IMAGE_TYPES = 25_000_000, 50 << 20, ("image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/tiff")


def image_error(content_type: Column, size: Column, width: Column, height: Column) -> Column:
    """Why an image isn't taken, or null: its type, its bytes, its pixels."""
    return F.when(~content_type.isin(*IMAGE_TYPES), "unsupported type").when(size > MOST_BYTES, "too large").when(width.cast("long") * height > MOST_PIXELS, "too many pixels")


def resized(width: Column, height: Column, to_width: int = 0, to_height: int = 0, keep_aspect: bool = True) -> Column:
    """struct(width, height) of a resized image; 0 leaves a side to the aspect ratio, and both sides bound the result."""
    ratio = width.cast("double") / height
    w, h = F.lit(to_width), F.lit(to_height)
    if keep_aspect and to_width and to_height:
        wide = ratio > to_width / to_height
        w, h = F.when(wide, w).otherwise(F.floor(to_height * ratio)), F.when(wide, F.floor(to_width / ratio)).otherwise(h)
    elif keep_aspect and to_height:
        w = F.floor(to_height * ratio)
    elif keep_aspect and to_width:
        h = F.floor(to_width / ratio)
    return F.struct(F.when(w > 0, w).otherwise(width).cast("int").alias("width"), F.when(h > 0, h).otherwise(height).cast("int").alias("height"))


def thumbnails(images: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """key, name, width, height of each thumbnail of images (key, width, height): one row a size."""
    sizes = sizes or {"small": 100, "medium": 300, "large": 800}
    each = F.array(*[F.struct(F.lit(n).alias("name"), resized(F.col("width"), F.col("height"), s, s).alias("to")) for n, s in sizes.items()])
    return images.select("key", F.explode(each).alias("t")).select(F.concat("key", F.lit("_thumb_"), "t.name").alias("key"), "t.name", "t.to.width", "t.to.height")


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: path, length, modificationTime and content, which is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
