"""Citation styles (V24): in-text and bibliography forms in six styles, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("mla", "apa", "chicago", "harvard", "asa", "sage")


def author_list(author: Column) -> Column:
    """Names of an author field; single words parted by a comma pair up as ``Last, First``."""
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace(author, " and ", ","), " & ", ","), ","), lambda x: F.trim(x))
    step = lambda acc, p: F.when(
        (acc["open"] != "") & ~p.contains(" "), F.struct(F.concat(acc["names"], F.array(F.concat(acc["open"], F.lit(", "), p))).alias("names"), F.lit("").alias("open"))
    ).when(~p.contains(" ") & (p != ""), F.struct(F.concat(acc["names"], F.when(acc["open"] != "", F.array(acc["open"])).otherwise(F.array().cast("array<string>"))).alias("names"), p.alias("open"))).otherwise(
        F.struct(F.concat(acc["names"], F.when(acc["open"] != "", F.array(acc["open"])).otherwise(F.array().cast("array<string>")), F.array(p)).alias("names"), F.lit("").alias("open"))
    )
    done = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("names"), F.lit("").alias("open")), step)
    return F.concat(done["names"], F.when(done["open"] != "", F.array(done["open"])).otherwise(F.array().cast("array<string>")))


def last_name(name: Column) -> Column:
    """What stands before the comma, else the last word."""
    return F.when(name.contains(","), F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def _swap(name: Column) -> Column:
    return F.when(name.contains(", "), F.concat(F.regexp_extract(name, r"^.*?, (.*)$", 1), F.lit(" "), F.substring_index(name, ", ", 1))).otherwise(name)


def _initials(words: Column) -> Column:
    return F.concat(F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ". "), F.lit("."))


def _inverted(name: Column) -> Column:
    first = F.regexp_extract(name, r"^.*?, (.*)$", 1)
    words = F.split(name, r"\s+")
    return (
        F.when(name.contains(", "), F.concat(F.substring_index(name, ", ", 1), F.lit(", "), _initials(F.split(first, r"\s+"))))
        .when(name.contains(" "), F.concat(F.element_at(words, -1), F.lit(", "), _initials(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))))))
        .otherwise(name)
    )


def _joined(names: Column, show, pair: str, many: str = " et al.") -> Column:
    first, second = show(F.element_at(names, 1)), show(F.try_element_at(names, F.lit(2)))
    return F.when(F.size(names) == 1, first).when(F.size(names) == 2, F.concat(first, F.lit(pair), second)).otherwise(F.concat(first, F.lit(many)))


def inline(style: str, author: Column, title: Column, year: Column, page: Column, names: Column | None = None) -> Column:
    """The in-text citation; no author gives Unknown, no year n.d.

    ``names``: the author list as a column, where several styles are wanted.
    """
    names = author_list(author) if names is None else names
    missing = F.coalesce(author, F.lit("")) == ""
    pg, yr = page.cast("string"), F.when(F.coalesce(year, F.lit(0)) == 0, "n.d.").otherwise(year.cast("string"))
    plain = _joined(names, last_name, " and ")
    amp = F.when(missing, "Unknown").otherwise(_joined(names, last_name, " & "))
    several = F.lower(author).contains(" and ") | author.contains(" & ")
    one = F.when(missing, "Unknown").otherwise(last_name(author))
    if style == "mla":
        return F.concat(F.lit("("), F.when(several, plain).otherwise(one), F.lit(" "), pg, F.lit(")"))
    if style == "apa":
        return F.concat(F.lit("("), amp, F.lit(", "), yr, F.lit(", p. "), pg, F.lit(")"))
    if style == "chicago":
        return F.concat(_joined(names, _swap, " and "), F.lit(", *"), title, F.lit("*, "), pg, F.lit("."))
    if style == "harvard":
        return F.concat(F.lit("("), amp, F.lit(" "), yr, F.lit(", p. "), pg, F.lit(")"))
    if style == "asa":
        return F.concat(F.lit("("), plain, F.lit(" "), yr, F.lit(":"), pg, F.lit(")"))
    if style == "sage":
        return F.concat(F.lit("("), plain, F.lit(", "), yr, F.lit(", p. "), pg, F.lit(")"))
    raise ValueError(f"unknown style {style}")


def bibliography(style: str, author: Column, title: Column, year: Column, publisher: Column, city: Column, editor: Column | None = None, doc_type: Column | None = None, names: Column | None = None) -> Column:
    """The bibliography entry; ``names`` as for :func:`inline`."""
    names = author_list(author) if names is None else names
    second = F.when(F.size(names) == 2, F.concat(F.element_at(names, 1), F.lit(", and "), _swap(F.try_element_at(names, F.lit(2)))))
    long = F.when(F.size(names) == 1, F.element_at(names, 1)).when(F.size(names) == 2, second).otherwise(F.concat(F.element_at(names, 1), F.lit(", et al.")))
    short = _joined(names, _inverted, ", & ", ", et al.")
    yr = year.cast("string")
    chapter = F.lit(False) if editor is None or doc_type is None else (doc_type == "chapter") & (F.coalesce(editor, F.lit("")) != "")
    ed = F.lit("") if editor is None else editor
    placed = F.when(F.coalesce(city, F.lit("")) != "", F.concat(city, F.lit(": "), publisher)).otherwise(publisher)
    if style == "mla":
        return F.when(chapter, F.concat(long, F.lit(". “"), title, F.lit(".” *"), ed, F.lit("*, "), publisher, F.lit(", "), yr, F.lit("."))).otherwise(F.concat(long, F.lit(". *"), title, F.lit("*. "), publisher, F.lit(", "), yr, F.lit(".")))
    if style in ("apa", "sage"):
        return F.when(chapter, F.concat(short, F.lit(" ("), yr, F.lit("). "), title, F.lit(". In "), ed, F.lit(", *"), title, F.lit("*. "), publisher, F.lit("."))).otherwise(F.concat(short, F.lit(" ("), yr, F.lit("). *"), title, F.lit("*. "), publisher, F.lit(".")))
    if style == "chicago":
        return F.concat(long, F.lit(". *"), title, F.lit("*. "), placed, F.lit(", "), yr, F.lit("."))
    if style == "harvard":
        return F.concat(short, F.lit(" ("), yr, F.lit(") *"), title, F.lit("*. "), placed, F.lit("."))
    if style == "asa":
        return F.concat(short, F.when(short.endswith("."), " ").otherwise(". "), yr, F.lit(". *"), title, F.lit("*. "), placed, F.lit("."))
    raise ValueError(f"unknown style {style}")
