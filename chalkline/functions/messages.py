"""Answers and messages as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .text import html_escape


def number_text(x: float | None, places: int = 3) -> str | None:
    """Fixed with trailing zeros off; scientific from 10000 and below 0.001."""
    if x is None:
        return None
    if abs(x) >= 1e4 or 0 < abs(x) < 1e-3:
        return f"{x:.{places}e}"
    return f"{x:.{places}f}".rstrip("0").rstrip(".")


def four_sections(given: Column, formula: Column, working: Column, answer: Column) -> Column:
    """The sections of a worked answer from arrays of lines; empty sections are left out."""
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(c, "\n"))) for name, c in (("Diberi", given), ("Formula", formula), ("Pengiraan", working), ("Jawapan", answer))]
    return F.concat_ws("\n\n", *parts)


#: What begins a section of an answer, the rules between sections, the mark of each kind of answer.
SECTION_HEADS = ("Diberi:", "Formula:", "Pengiraan:", "Jawapan:", "Diberi :", "Formula :", "Pengiraan :", "Jawapan :", "Langkah:", "Langkah :", "Given:", "Calculation:", "Answer:", "Given :", "Calculation :", "Answer :", "Step:", "Step :")
RULES = ("---", "───", "━━━", "─────────────")
MARKS = {"calculation": "🧮", "theory": "📚", "fallback": "ℹ️", "error": "⚠️"}
OTHER_MARK = "💬"
STEP = r"(?i)=.*(?:mol|dm3|cm3|kJ|J|g)\b"


def is_formula_line(line: Column) -> Column:
    """A line with an arrow, or an indented step of a calculation."""
    arrow = line.rlike("->|→|⇌|<->")
    return F.trim(line).isNotNull() & (arrow | (line.startswith("  ") & line.rlike(STEP)))


def answer_html(text: Column, kind: Column | str = "calculation", name: str = "Assistant") -> Column:
    """An answer as markup: a title, section heads bold, formulas as code, rules as dashes; what follows a line of --- is an explanation in italics."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    mark = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair)), kind), F.lit(OTHER_MARK))
    head = rf"^\s*({'|'.join(SECTION_HEADS)})\s*"

    def line(x: Column) -> Column:
        x = F.rtrim(x)
        bare, first = F.trim(x), F.regexp_extract(x, head, 1)
        rest = F.trim(F.regexp_replace(x, head, ""))
        bold = F.concat(F.lit("<b>"), html_escape(first), F.lit("</b>"), F.when(rest != "", F.concat(F.lit(" "), html_escape(rest))).otherwise(""))
        return F.when(first != "", bold).when(is_formula_line(x), F.concat(F.lit("<code>"), html_escape(bare), F.lit("</code>"))).when(bare.isin(*RULES), RULES[-1]).otherwise(html_escape(x))

    parts = F.split(text, "\n---\n", 2)
    explained = F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    body = F.array_join(F.transform(F.split(F.trim(parts[0]), "\n"), line), "\n")
    return F.concat(F.lit("<b>"), mark, F.lit(f" {name}</b>\n\n"), body, F.when(explained != "", F.concat(F.lit("\n\n<i>"), html_escape(explained), F.lit("</i>"))).otherwise(""))


def theory_html(text: Column, name: str = "Assistant") -> Column:
    return F.concat(F.lit(f"📚 <b>{name}</b>\n\n"), F.array_join(F.transform(F.split(text, "\n"), lambda x: html_escape(F.rtrim(x))), "\n"))


def notice_html(message: Column, kind: str = "fallback") -> Column:
    return F.concat(F.lit(f"{MARKS[kind]} "), html_escape(message))


def sources_html(topics: Column, lang: str = "BM", most: int = 2) -> Column:
    """A footer that names the first topics; empty without any."""
    named = F.transform(F.filter(F.slice(topics, 1, most), lambda t: t != ""), lambda t: F.concat(F.lit("• "), html_escape(t)))
    label = "📖 Sumber:" if lang == "BM" else "📖 Sources:"
    return F.when(F.size(named) > 0, F.concat(F.lit(f"\n\n<i>{label} "), F.array_join(named, ", "), F.lit("</i>"))).otherwise("")


def timing_html(ms: Column, cached: Column) -> Column:
    return F.concat(F.lit("\n<i>"), F.when(cached, "⚡ Cache").otherwise("⏱"), F.lit(" "), F.bround(ms, 0).cast("bigint"), F.lit("ms</i>"))


def preview(text: Column, most: int) -> Column:
    """The start of a text, with dots if there is more."""
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise(""))


#: How a reader is asked about what was recognised: language -> (head, foot), and what is said if nothing was.
ASKED = {"BM": ("Teks yang dibaca daripada gambar:", "Betulkah? Jawab ya atau tidak."), "EN": ("Text read from the image:", "Is this right? Answer yes or no.")}
UNREADABLE = {"BM": "Gambar kurang jelas. Hantar gambar lain atau taip soalan.", "EN": "The image is not clear. Send another or type the question."}


def confirmation(text: Column, tier: Column, lang: str = "BM", most: int = 200) -> Column:
    """What to say of recognised text by its tier of confidence: nothing if it is high, a preview to confirm, or a request to try again."""
    head, foot = ASKED[lang]
    ask = F.concat(F.lit(f"{head}\n\n<code>"), html_escape(preview(text, most)), F.lit(f"</code>\n\n{foot}"))
    return F.when(tier == "medium", ask).when(tier == "low", UNREADABLE[lang])


def denial(reason: Column, messages: dict[str, str], otherwise: str) -> Column:
    """The message of the first prefix of reason."""
    out = F.lit(otherwise)
    for prefix, message in reversed(messages.items()):
        out = F.when(reason.startswith(prefix), message).otherwise(out)
    return out


def percent_bar(used: Column, limit: Column, width: int = 10) -> Column:
    filled = F.least(F.lit(width), F.floor(F.try_divide(used * width, limit))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))


def pieces(text: str, most: int = 3900) -> Iterator[str]:
    """A text in pieces of at most `most` characters, cut at a paragraph, else a line, else a blank, and not inside a tag."""
    while len(text) > most:
        cut = next((c for s in ("\n\n", "\n", " ") if (c := text.rfind(s, 1, most)) > 0), most)
        opened = text.rfind("<", 0, cut)
        if opened > 0 and text.find(">", opened, cut) < 0:
            cut = opened
        yield text[:cut].rstrip()
        text = text[cut:].lstrip()
    if text:
        yield text


class _Split:
    def eval(self, text: str, most: int):
        for i, part in enumerate(pieces(text or "", most)):
            yield i, part


split_message = udtf(_Split, returnType=T.StructType([T.StructField("number", T.IntegerType()), T.StructField("part", T.StringType())]))
