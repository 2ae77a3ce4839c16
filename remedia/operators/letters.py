"""Letters rendered from computed facts, and the check that they state nothing else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.functions.dates import iso
from remedia.functions.text import citations, dates_quoted, first_sentence, sentences, slug
from remedia.session import once

SECTION = "struct<id:string,regulation:string,title:string,text:string>"


def _strings(*items) -> Column:
    return F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items])


def _none() -> Column:
    return F.array().cast("array<string>")


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def _section(heading: str, lines: Column) -> Column:
    """A heading with its lines, or nothing when there are none."""
    return F.when(F.size(lines) > 0, F.concat(_strings("", heading, ""), lines)).otherwise(_none())


def render(
    complaint_id: Column, issue: Column, sections: Column, deadlines: Column,
    issues: Column, reason_code: Column,
) -> Column:
    """The letter before any revision remark. All parts come computed."""
    opening = _strings(
        F.concat(F.lit("Re: dispute "), F.coalesce(complaint_id.cast("string"), F.lit("n/a")),
                 F.lit(" - "), F.coalesce(issue, F.lit("unspecified issue"))),
        "", policy.LETTER_THANKS, "", policy.HEADING_APPLIES, "")
    quoted = F.transform(
        F.slice(F.coalesce(sections, F.array().cast(f"array<{SECTION}>")), 1, 3),
        lambda s: F.concat(F.lit("- "), first_sentence(s["text"]), F.lit(" [reg:"), s["id"],
                           F.lit("].")))
    first_cited = F.coalesce(
        F.get(deadlines["citations"], F.lit(0)), F.lit(policy.DEFAULT_NOTICE_CITATION))
    dated = F.transform(deadlines["deadlines"], lambda d: F.concat(
        F.lit("- "), _capital(d["name"]), F.lit(": "), iso(d["due"]), F.lit(" ("), d["basis"],
        F.lit(") [calc:"), slug(d["name"]), F.lit("] [reg:"), d["citation"], F.lit("].")))
    dates = F.when(
        F.coalesce(~deadlines["consumer_notice_timely"], F.lit(False)),
        _strings("", F.concat(F.lit(policy.LETTER_LATE), first_cited, F.lit("].")))
    ).otherwise(F.concat(_strings("", policy.HEADING_DATES, ""), dated))
    bullets = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    means = _section(policy.HEADING_MEANS, bullets(deadlines["findings"]))
    stated = F.coalesce(reason_code["code"] != "", F.lit(False)) | F.coalesce(
        reason_code["issue"] != "", F.lit(False))
    route = F.when(reason_code["mapped"], _strings("", F.concat(
        F.lit(policy.LETTER_CODE), reason_code["code"], F.lit(" ("), reason_code["label"],
        F.lit("). " + policy.LETTER_EVIDENCE), F.concat_ws(", ", reason_code["evidence"]),
        F.lit(".")))).when(stated, _strings("", policy.LETTER_UNMAPPED)).otherwise(_none())
    needed = _section(policy.HEADING_NEEDED, bullets(F.transform(
        F.filter(issues, lambda i: i["severity"] == "error"), lambda i: i["message"])))
    closing = _strings("", policy.LETTER_CLOSING)
    return F.concat_ws("\n", F.concat(opening, quoted, dates, means, route, needed, closing))


def remark(critique_text: Column) -> Column:
    """The note a rejected letter is sent back with."""
    return F.concat(F.lit("<!-- revised after review: "), F.substring(critique_text, 1, 200),
                    F.lit(" -->"))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _claims_without_citation(text: Column) -> Column:
    """Sentences of eight words or more that state a fact and cite nothing.

    A sentence piece that begins with a heading, a remark or a table bar is not
    checked, so the first bullet under a heading is exempt.
    """
    pieces = F.transform(F.filter(sentences(text), lambda s: ~s.rlike(policy.CITATION_PATTERN)),
                         lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    # each piece beside its lower-case form, which many words are looked up in
    paired = F.transform(F.filter(
        pieces, lambda s: ~(s.startswith("#") | s.startswith("<!--") | s.startswith("|"))),
        lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))

    def uncited(p: Column) -> Column:
        long_enough = F.size(F.split(p["s"], r"(?U)\s+")) >= 8
        return (_any(p["low"], policy.FACT_MARKERS) & ~_any(p["low"], policy.BOILERPLATE)
                & long_enough)

    return F.transform(F.filter(paired, uncited), lambda p: F.substring(p["s"], 1, 160))


def _supplied(deadlines: Column, valid_sections: Column) -> tuple[Column, Column]:
    """What a letter may cite, and the dates it may quote."""
    computed = lambda f: F.coalesce(
        F.transform(deadlines["deadlines"], f), _none())
    return (F.concat(valid_sections, computed(lambda d: slug(d["name"]))),
            computed(lambda d: iso(d["due"])))


def _judged(cited: Column, uncited: Column, lost: Column, invented: Column) -> Column:
    return F.struct(
        ((F.size(lost) == 0) & (F.size(invented) == 0) & (F.size(uncited) == 0)).alias("passed"),
        F.size(cited).alias("citations"), (F.size(cited) - F.size(lost)).alias("resolved"),
        lost.alias("unresolved"), uncited.alias("uncited_claims"),
        invented.alias("invented_dates"))


def verify(text: Column, deadlines: Column, valid_sections: Column) -> Column:
    """Citations resolve, dates were computed, claims are cited. Repeats are counted."""
    known, dues = _supplied(deadlines, valid_sections)
    cited = citations(text)
    lost = F.filter(cited, lambda c: ~F.array_contains(known, c))
    invented = F.filter(dates_quoted(text), lambda d: ~F.array_contains(dues, d))
    return _judged(cited, _claims_without_citation(text), lost, invented)


def _verified(df: DataFrame, text: str, out: str) -> DataFrame:
    """``verify`` of a column against ``_known`` and ``_dues``, each search of the text made once."""
    parts = ["_cited", "_quoted", "_uncited", "_lost", "_invented"]
    found = once(df.withColumns({
        "_cited": citations(F.col(text)), "_quoted": dates_quoted(F.col(text)),
        "_uncited": _claims_without_citation(F.col(text))}), *parts[:3])
    judged = once(found.withColumns({
        "_lost": F.filter("_cited", lambda c: ~F.array_contains("_known", c)),
        "_invented": F.filter("_quoted", lambda d: ~F.array_contains("_dues", d))}), *parts[3:])
    check = _judged(*[F.col(n) for n in ("_cited", "_uncited", "_lost", "_invented")])
    return once(judged.withColumn(out, check), out).drop(*parts)


def _joined(check: Column, more: Column) -> Column:
    """The check of a letter with a remark added below it."""
    lists = ("unresolved", "uncited_claims", "invented_dates")
    return F.struct(
        (check["passed"] & more["passed"]).alias("passed"),
        *[(check[n] + more[n]).alias(n) for n in ("citations", "resolved")],
        *[F.concat(check[n], more[n]).alias(n) for n in lists])


def critique(check: Column) -> Column:
    named = lambda field: F.concat_ws(", ", check[field])
    return F.concat_ws("; ", F.filter(F.array(
        F.when(F.size(check["unresolved"]) > 0, F.concat(
            F.lit("citations that resolve to nothing: "), named("unresolved"))),
        F.when(F.size(check["invented_dates"]) > 0, F.concat(
            F.lit("dates not produced by the rules engine: "), named("invented_dates"),
            F.lit("; quote only the supplied deadlines"))),
        F.when(F.size(check["uncited_claims"]) > 0, F.concat(
            F.size(check["uncited_claims"]).cast("string"),
            F.lit(" factual sentence(s) with no citation")))),
        lambda p: p.isNotNull()))


def draft_and_verify(
    df: DataFrame, valid_sections: Column, attempts: int = policy.MAX_DRAFT_ATTEMPTS,
    complaint_id: str = "complaint_id", issue: str = "issue", sections: str = "sections",
    deadlines: str = "deadlines", validation: str = "validation",
    reason_code: str = "reason_code",
) -> DataFrame:
    """Add ``letter``, ``verification``, ``verification_passed`` and ``attempts``.

    A rejected letter is redrafted with the reviewer's remark, up to ``attempts``
    times in all. A redraft is the same letter with the remark below it, so it
    fails again and only the remark needs checking: the letter itself is rendered
    and checked once. ``verification_passed`` depends on that first check alone,
    which keeps a filter on it cheap wherever the optimiser puts it.
    """
    keep = df.columns
    known, dues = _supplied(F.col(deadlines), valid_sections)
    work = once(df.withColumns({"_known": known, "_dues": dues, "_base": render(
        F.col(complaint_id), F.col(issue), F.col(sections), F.col(deadlines),
        F.col(f"{validation}.issues"), F.col(reason_code))}), "_known", "_dues", "_base")
    work = _verified(work, "_base", "_check")
    last = "_check"
    for attempt in range(2, attempts + 1):
        note, joined = f"_note{attempt}", f"_check{attempt}"
        work = once(work.withColumn(note, F.when(
            ~F.col("_check.passed"), remark(critique(F.col(last))))), note)
        work = once(_verified(work, note, "_more").withColumn(
            joined, _joined(F.col("_check"), F.col("_more"))), joined).drop("_more")
        last = joined
    passed = F.col("_check.passed")
    if attempts == 1:
        letter, final = F.col("_base"), F.col("_check")
    else:
        letter = F.when(passed, F.col("_base")).otherwise(
            F.concat("_base", F.lit("\n\n"), F.col(f"_note{attempts}")))
        final = F.when(passed, F.col("_check")).otherwise(F.col(last))
    done = work.select(
        *keep, letter.alias("letter"), final.alias("verification"),
        passed.alias("verification_passed"),
        F.when(passed, 1).otherwise(attempts).alias("attempts"))
    return once(done, "letter", "verification")
