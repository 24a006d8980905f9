"""Column helpers: text measures with UTF-16 semantics, path functions and predicates. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

ESCAPED_SCHEME = r"^[A-Za-z][A-Za-z0-9+\-.]*:"


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def utf16_key(c: Column) -> Column:
    """A sort key for the order of UTF-16 code units."""
    return F.encode(c, "UTF-16BE")


def approx_tokens(c: Column) -> Column:
    return F.ceil(utf16_length(c) / 4).cast("long")


def is_text(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def lossy_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is invalid, without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}", "")


def line_count(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.size(F.split(c, "\n", -1))).cast("long")


def metadata_text(name: Column, description: Column) -> Column:
    return F.concat_ws(" ", name, description)


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise(F.lit(""))


def normalize(p: Column) -> Column:
    """Drops empty and `.` segments and resolves `..`; leading `..` stay, a leading slash goes."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(p, "/", -1), empty, step), "/")


def strip_fragment(p: Column) -> Column:
    return F.substring_index(p, "#", 1)


def is_relative(p: Column) -> Column:
    return (F.length(p) > 0) & ~p.startswith("#") & ~p.rlike(ESCAPED_SCHEME)


def escapes_root(normal: Column) -> Column:
    return (normal == "..") | normal.startswith("../")


def python_module(p: Column) -> Column:
    fits = F.contains(p, F.lit("/")) & p.endswith(".py")
    return F.when(fits, F.replace(F.regexp_replace(p, r"\.py\z", ""), F.lit("/"), F.lit(".")))


def js_specifier(p: Column) -> Column:
    tail = r"\.(?:js|mjs|cjs|jsx|ts|mts|cts|tsx)\z"
    return F.when(F.contains(p, F.lit("/")) & p.rlike(tail), F.regexp_replace(p, tail, ""))


def ancestors(p: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(p, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def is_ignored(p: Column, ignore=K.DEFAULT_IGNORE) -> Column:
    return F.arrays_overlap(F.split(p, "/", -1), F.array(*map(F.lit, ignore))) if ignore else F.lit(False)


def is_root(p: Column) -> Column:
    return ~F.contains(p, F.lit("/"))


def is_canonical_readme(p: Column) -> Column:
    return is_root(p) & F.lower(p).isin(*K.README_NAMES)


def is_root_readme(p: Column) -> Column:
    return is_canonical_readme(p) | (is_root(p) & F.lower(p).rlike(r"^readme\.[a-z]{2,3}(?:-[a-z]{2,4})?\.md\z"))


def is_license_file(p: Column) -> Column:
    return is_root(p) & F.lower(p).isin(*K.LICENSE_NAMES)


def never_orphan(p: Column) -> Column:
    return is_root_readme(p) | (is_root(p) & F.lower(p).isin(*K.CONVENTION_FILES, *K.SCAFFOLDING_FILES))


def kind(p: Column, readme: Column, license_: Column) -> Column:
    """First match wins; a null pick matches nothing."""
    first = F.substring_index(p, "/", 1)
    return (
        F.when(p == K.SKILL_FILE, "instructions").when(F.coalesce(p == readme, F.lit(False)), "readme").when(F.coalesce(p == license_, F.lit(False)), "license")
        .when(is_root_readme(p), "readme").when(first == "scripts", "script").when(first == "references", "reference").when(first == "assets", "asset").otherwise("other")
    )


def license_head(text: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, K.LICENSE_HEAD_LINES), "\n")


def spdx_of_declared(declared: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in K.SPDX_IDS:
        out = F.when(F.lower(declared) == name.lower(), name).otherwise(out)
    return out


def spdx_of_head(head: Column) -> Column:
    low, out = F.lower(head), None
    for name, needed in K.SPDX_HEADS:
        fits = F.lit(True)
        for part in needed:
            fits = fits & F.contains(low, F.lit(part.lower()))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9-]+\z") & ~name.startswith("-") & ~name.endswith("-") & ~F.contains(name, F.lit("--"))


def format_bytes(n: Column) -> Column:
    def one(x: Column) -> Column:
        tenths = F.floor(x * 10 + 0.5).cast("long")
        whole = (tenths / 10).cast("long").cast("string")
        return F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / (1024 * 1024)), F.lit(" MB")))
