"""Path, link and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The resource classes and their extensions; any other file is binary.
CLASSES = {
    "text": "txt csv tsv json yaml yml toml ini cfg conf log xml rs py ts tsx js jsx sh c h cpp hpp go java rb swift kt css scss sql",
    "html": "html htm",
    "pdf": "pdf",
    "image": "png jpg jpeg gif webp svg avif",
    "media": "mp3 wav mp4 mov webm",
}


def extension(path: Column) -> Column:
    """The lower-case extension of the file name; empty without one."""
    return F.lower(F.regexp_extract(path, "[^/]\\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    """note for .md or no extension, else resource."""
    return F.when(extension(path).isin("", "md"), "note").otherwise("resource")


def resource_class(path: Column) -> Column:
    out = F.lit("binary")
    for name, own in CLASSES.items():
        out = F.when(extension(path).isin(*own.split()), name).otherwise(out)
    return out


def hidden(path: Column) -> Column:
    """Whether a part of the path starts with a dot."""
    return path.rlike("(^|/)\\.")


def external(target: Column) -> Column:
    """Whether a Markdown target leaves the vault: a scheme, an absolute path or a fragment."""
    return target.rlike("^(/|#|[A-Za-z]+:)")


def under(path: Column, folder: str) -> Column:
    return path.startswith(folder.rstrip("/") + "/")


def inside(path: str, folder: str) -> bool:
    """Whether a path is a folder or lies under it."""
    return f"{path}/".startswith(f"{folder.rstrip('/')}/")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def edge_id(src: Column, target: Column, kind_: Column, occurrence: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", src, target, kind_, occurrence.cast("string")), 256), 1, 32)


def resolved(base: Column, target: Column) -> Column:
    """`target` seen from the folder of `base`, with . and .. taken out; null above the root."""
    folder = F.regexp_extract(base, "^(.*)/[^/]*$", 1)
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    walk = F.aggregate(parts, start, lambda s, p: F.when(s.isNull() | ((p == "..") & (F.size(s) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.nullif(F.array_join(walk, "/"), F.lit(""))


# The verbs that relate notes, how each reads from the other end, and those that read alike.
INVERSE = {"references": "referenced-by", "supports": "supported-by", "contradicts": "contradicts"}


def label(kind_: Column, direction: Column) -> Column:
    """How an edge reads from the note it is seen from."""
    back = kind_
    for verb, inverse in INVERSE.items():
        back = F.when(kind_ == verb, inverse).otherwise(back)
    return F.when(direction == "in", back).otherwise(kind_)
