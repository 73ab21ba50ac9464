"""Keys, packages and categories of call frames, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the profiler gives to frames of its own, and frames that say nothing about who called.
SYNTHETIC = ("(root)", "(program)", "(idle)", "(garbage collector)", "(gc)")
TRANSPARENT = ("runMicrotasks", "(garbage collector)", "(program)", "ErrorPrepareStackTrace")
TRANSPARENT_IN = {"kareem": ("syncWrapper", "wrap")}
ANCHORS = ("/dist/", "/build/", "/src/", "/app/")
MODULES = "node_modules/"


def first_segment(path: Column) -> Column:
    """What stands before the first slash; ``.`` for a bare file name; empty stays empty."""
    return F.when(path == "", "").when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(".")


def npm_name(rest: Column) -> Column:
    """The package of a path below ``node_modules/``, with its scope."""
    first, second = F.split_part(rest, F.lit("/"), F.lit(1)), F.split_part(rest, F.lit("/"), F.lit(2))
    scoped = first.startswith("@") & (second != "")
    return F.when(first == "", "(unknown)").when(scoped, F.concat_ws("/", first, second)).otherwise(first)


def app_dir(url: Column) -> Column:
    """The directory that names first-party code: below the first anchor that has one, else the first of the path."""
    path = F.regexp_replace(url, "^file://", "")
    below = []
    for anchor in ANCHORS:
        name = anchor.strip("/")
        found = first_segment(F.substring_index(path, anchor, -1))
        label = F.concat(F.lit("src/"), found) if name == "src" else found
        below.append(F.when(path.contains(anchor) & (found != ""), F.when(found == ".", name).otherwise(label)))
    top = first_segment(F.regexp_replace(path, "^/", ""))
    return F.coalesce(*below, F.when(top != "", top), F.lit("(app)"))


def _unified(url: Column) -> Column:
    return F.replace(url, F.lit("\\"), F.lit("/"))


def _rules(url: Column, native, builtin, npm, evaluated, app) -> Column:
    u = _unified(url)
    is_eval = u.contains("eval at ") | u.startswith("evalmachine.") | u.startswith("webpack://") | u.startswith("VM")
    return (
        F.when(u == "", native)
        .when(u.startswith("node:") | u.startswith("internal/"), builtin)
        .when(u.contains(MODULES), npm(u))
        .when(is_eval, evaluated)
        .otherwise(app(u))
    )


def package(url: Column, name: Column) -> Column:
    """The package that a frame belongs to."""
    native = F.when(name.isin(*SYNTHETIC), name).when(name == "", "(program)").otherwise("(native)")
    return _rules(
        url, native, F.lit("node:builtin"), lambda u: npm_name(F.substring_index(u, MODULES, -1)), F.lit("(eval)"), lambda u: F.concat(F.lit("app:"), app_dir(u))
    )


def category(url: Column, name: Column) -> Column:
    """native, node_modules, user or idle."""
    idle = F.when((url == "") & (name == "(idle)"), "idle").otherwise("native")
    return _rules(url, idle, F.lit("native"), lambda u: F.lit("node_modules"), F.lit("user"), lambda u: F.lit("user"))


def function_key(script: Column, url: Column, line: Column, name: Column) -> Column:
    """Script (or URL where that is empty), one-based line and name."""
    return F.concat_ws(":", F.when(script != "", script).otherwise(url), (line + 1).cast("string"), name)


def function_display(url: Column, line: Column, name: Column) -> Column:
    shown = F.when(name == "", "(anonymous)").otherwise(name)
    return F.when(url == "", shown).otherwise(F.concat(shown, F.lit(" ("), url, F.lit(":"), (line + 1).cast("string"), F.lit(")")))


def file_key(url: Column) -> Column:
    return F.when(url == "", "(native)").otherwise(url)


def frame_name(display: Column) -> Column:
    return F.substring_index(display, " (", 1)


def transparent(display: Column, pkg: Column) -> Column:
    """Whether callers should be looked for above this frame; unknown frames aren't transparent."""
    name = frame_name(display)
    in_package = [(pkg == p) & name.isin(*names) for p, names in TRANSPARENT_IN.items()]
    return F.coalesce(reduce(lambda a, b: a | b, in_package, name.isin(*TRANSPARENT)), F.lit(False))


def keys(script: Column, url: Column, line: Column, name: Column) -> list[Column]:
    """fn_key, fn_display, file_key, pkg_key and category of a frame without nulls."""
    return [
        function_key(script, url, line, name).alias("fn_key"), function_display(url, line, name).alias("fn_display"),
        file_key(url).alias("file_key"), package(url, name).alias("pkg_key"), category(url, name).alias("category"),
    ]
