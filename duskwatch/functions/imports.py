"""Which packages a file imports, and whether that opens an entry's gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.fixed import JS_EXTENSIONS
from duskwatch.functions.binding import let
from duskwatch.functions.text import any_true, js_trim

# The import forms that count, as patterns.
JS_IMPORT = (
    r"(?=[ier])(?<!\w)(?:(?:import|export)(?!\w)[^;'\"`]*?(?<!\w)from\s*"
    r"|import\s*(?:\(\s*)?|require\s*\(\s*)(['\"`])([^'\"`]+)\1"
)
PYTHON_FROM = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import(?!\w)"
PYTHON_IMPORT = r"(?m)^[ \t]*import[ \t]+(.+)$"
PYTHON_ALIAS = r"[ \t]+as[ \t]+"


def js_imports(text: Column) -> Column:
    """Raw specifiers of import, export-from, dynamic import and require."""
    found = F.regexp_extract_all(text, F.lit(JS_IMPORT), F.lit(2))
    mentions = [F.contains(text, F.lit(w)) for w in ("import", "export", "require")]
    return F.when(any_true(*mentions), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def python_imports(text: Column) -> Column:
    """Top-level module names; relative imports name none."""

    def top(name: Column) -> Column:
        return F.split_part(js_trim(name), F.lit("."), F.lit(1))

    froms = F.transform(F.regexp_extract_all(text, F.lit(PYTHON_FROM), F.lit(1)), top)
    lists = F.regexp_extract_all(text, F.lit(PYTHON_IMPORT), F.lit(1))
    names = F.flatten(F.transform(lists, lambda names: F.split(names, ",")))
    plain = F.transform(
        names, lambda name: top(F.split(js_trim(name), PYTHON_ALIAS)[0])
    )
    modules = F.filter(F.concat(froms, plain), lambda name: name != "")
    return F.when(F.contains(text, F.lit("import")), F.array_distinct(modules)).otherwise(
        F.array().cast("array<string>")
    )


def is_gateable(ext: Column) -> Column:
    return ext.isin(*JS_EXTENSIONS, "py")


def imports_of(text: Column, ext: Column) -> Column:
    return (
        F.when(ext == "py", python_imports(text))
        .when(ext.isin(*JS_EXTENSIONS), js_imports(text))
        .otherwise(F.array().cast("array<string>"))
    )


def import_prefixes(imports: Column) -> Column:
    """Every specifier and what stands before a slash in it: the packages an import is of, or of a subpath of."""

    def prefixes(specifier: Column) -> Column:
        parts = F.split(specifier, "/", -1)
        return let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, 1, n), "/")))

    return F.array_distinct(F.flatten(F.transform(imports, prefixes)))


def gate_open(prefixes: Column, sdks: Column, gateable: Column) -> Column:
    """No gate, no import parsing for the language, or an import of (a subpath of) an sdk, given :func:`import_prefixes`."""
    return (F.size(sdks) == 0) | ~gateable | F.arrays_overlap(prefixes, sdks)
