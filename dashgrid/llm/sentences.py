"""Sentence units of texts in many languages and scripts, by masking and script-specific terminators.

All in SQL expressions, row by row, without a shuffle: signs that end nothing (in decimals, addresses,
initials, abbreviations, formulas and quotations inside a sentence) are masked by a private-use character
of the same length; the text is cut at hard breaks (paragraph labels, claims, blank lines), then at the
terminators of its scripts; since masks keep every offset, a unit's text is restored from the original.

Defined results: null, empty and blank texts give no rows; a text without any terminator is one unit;
offsets count Unicode code points; repeated rows give their units each; an empty table gives none; the three
private-use characters, if a text already holds them, count as letters. Very long texts are cut like others: offsets are
summed and units cut out in blocks, so the work stays about in proportion to the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT, MASK, HARD = "\ue000", "\ue001", "\ue002"
#: Characters that count as white space around a unit.
BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_S = r"[\s\x1c-\x1f\x85\xa0  -     　]"
_QUOTE_END = "\"”»’」』"
CLOSE = _QUOTE_END + r")）\]】"
#: Terminators beside the Latin ones: the frequent ones, then Unicode's other sentence terminals (ranges;
#: the full-width stop, which numbers claims, left out) and the Tibetan strokes.
_END = "。！？｡।॥؟۔"
_RARE = (r"\u0589\u061d\u061e\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e\u0f0d-\u0f12\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945"
         r"\u1aa8-\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d\u1b7e\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047-\u2049\u2e2e\u2e3c\u2e53\u2e54\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877"
         r"\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d-\uaa5f\uaaf0\uaaf1\uabeb\ufe12\ufe15\ufe16\ufe52\ufe56\ufe57")
# the outer ranges dismiss most characters at once
_RARE = rf"\u0589-\ufe57&&[\u0589\u061d\u061e\u0700-\u083e\u0f0d-\u1c7f\u203c-\u2049\u2e2e-\u2e54\ua4ff-\uabeb\ufe12-\ufe57]&&[{_RARE}]"
#: What a full stop may follow that ends a sentence though the next word begins at once.
_WORD_END = r"[\p{L}\p{N})%\]°]"
_LABEL = r"[\[【［]\d{2,6}[\]】］]"
_THAI = r"฀-๿"

#: Abbreviations that never end a sentence before a space, then those that do unless it goes on in lower
#: case or with a number; in any case, a space allowed after inner stops. Fixed values.
NEVER_LAST = (
    "fig", "figs", "ref", "refs", "cf", "e.g", "i.e", "approx", "vs", "viz", "no", "nos", "ex", "incl", "ver", "nr", "abb", "bsp", "ca", "z.b", "d.h", "anm", "abs", "kap", "ziff", "tab",
    "ggs", "fa", "bzw", "env", "réf", "p.ej", "aprox", "pág", "c.-à-d", "vgl", "ggf", "sog", "resp", "dr", "mr", "mrs", "prof", "st",
    "eq", "sec", "vol", "pp",
)
LAST_OR_NOT = ("etc", "inc", "co", "ltd", "corp", "a.m", "p.m", "d.c", "a.c", "usw", "u", "s", "j")


def _behind(words: Sequence[str]) -> str:
    """Looks back from a stop for any of the words; they are grouped by last letter, so that most stops are dismissed at once."""
    groups: dict[str, list[str]] = {}
    for w in words:
        # accents may be separate characters, or damaged by a wrong encoding
        spelled = {w, unicodedata.normalize("NFD", w), w.encode().decode("latin-1").lower()}
        for form in sorted({x for y in spelled for x in (y, y.replace(".", ". "))}):
            groups.setdefault(w[-1], []).append(form.replace(".", "[.]").replace(" ", _S))
    return "(?iu:" + "|".join(
        rf"(?<={last}[.])(?:{'|'.join(rf'(?<=(?<![\p{{L}}\p{{N}}-]){f}[.])' for f in forms)})" for last, forms in groups.items()) + ")"


def _mask_stops(t: Column) -> Column:
    """Full stops that end nothing."""
    token = (r"(?=[\p{L}\p{N}(\\])(?<=[\p{L}\p{N})\]}%][.])"  # inside a token, unless a space is missing between two words
             rf"(?!\p{{Lu}}\p{{Ll}}(?<={_WORD_END}[.]..))")
    going_on = rf"(?={_S}*[\p{{Ll}},;:)]|[ \t\xa0]*\p{{N}}){_behind(LAST_OR_NOT)}"
    caps = rf"(?={_S}+\p{{Lu}}{{2}})(?<=\b(?:ETC|INC)[.])"  # texts in capitals
    never = rf"(?={_S}|\p{{N}}|\(){_behind(NEVER_LAST)}"
    # German and Spanish two-word abbreviations, ordinals of dates, u. between names, s. before a number
    pairs = rf"(?={_S}?(?:B|h|ej)[.]|{_S}\p{{N}})(?<=(?<![\p{{L}}\p{{N}}-])[zdp][.])|(?={_S}+\p{{Lu}})(?:(?<={_S}u[.])|(?<=\(s[.])|(?<=\b[Aa]m{_S}\p{{N}}{{1,2}}[.])|(?={_S}A[.])(?<=\bS[.]))"
    # before a comma, and a decimal torn apart behind a comparison
    torn = rf"(?=[,;:])|(?= \p{{N}})(?<=[≥≤=<>;]{_S}?\p{{N}}{{1,3}}[.])"
    # scripts whose sentences don't end in a full stop
    script = rf"(?<=[\p{{IsDevanagari}}{_THAI}][.])"
    return F.regexp_replace(t, rf"[.](?:{token}|(?=[.])|(?<=[.][.])|{script}|{never}|{going_on}|{caps}|{pairs}|{torn})", MASK)


def _mask_signs(t: Column, wide: Column, rare: Column) -> Column:
    """Marks inside formulas and at the end of quotations that their sentence goes on after."""
    formula = (rf"(?<=[?!])(?:(?={_S}?(?:[/≥≤=<>×·^*+â]|&[lg]t;))|(?=[^\s{CLOSE}?!.\xa0　\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])|(?<={_S}[?])(?=[?])|(?<={_S}[?]{{2}})(?={_S}+\p{{L}}))")
    on = (rf"(?={_S}?Â?[{_QUOTE_END}](?:{_S}+(?:\p{{Ll}}|\p{{Lu}}{{2,}}{_S}+\p{{Lu}}{{2}}|[\p{{IsDevanagari}}\p{{IsArabic}}{_THAI}]|[–—])|{_S}*[,;:，、；：؛،]|[とはがをのにで]))")
    mask = lambda first: F.regexp_replace(t, rf"{first}(?:{on}|{formula})", MASK)
    return F.when(rare, mask(f"(?:[.!?{_END}]|[{_RARE}])")).when(wide, mask(f"[.!?{_END}]")).otherwise(mask("[.!?]"))


#: Opening sign, closing sign and all signs of quotations.
_PAIRS = (
    (r"\"(?<![\p{L}\p{N}.!?,;:%)\]]\")(?=[^\s\"])", r"(?<=\S)\"(?![\p{L}\p{N}])", '"'), ("“", "”", "“”"), ("«", "»", "«»"), ("‹", "›", "‹›"), ("「", "」", "「」"), ("『", "』", "『』"),
    ("„", "[“”]", "„“”"),
    (r"‘(?<![\p{L}\p{N}]‘)(?=\S)", r"’(?!\p{L})", "‘"),  # the closing sign may be an apostrophe
)


def _mask_quoted(t: Column, opening: str, closing: str, signs: str) -> Column:
    """All marks between the opening and the closing sign of a quotation in a paragraph, but those right before the closing one."""
    marks, line = ".!?" + _END, rf"\n(?![ \t\r]*\n|[ \t]*{_LABEL})"
    run = lambda no: rf"[^{no}\n]*+(?:{line}[^{no}\n]*+)*+"
    inside = run(signs) if signs != "‘" else rf"(?:{run('‘’')}(?!{closing})’)*+{run('‘’')}"
    # from the opening sign, or on from the last mark of the same quotation
    return F.regexp_replace(t, rf"((?:{opening}|\G(?!^)){run(signs + marks)})[{marks}](?![{marks}]*[ \xa0]?{closing})(?={inside}{closing})", "$1" + MASK)


#: A repeated word is looked for up to this length; longer ones, such as formulas, aren't repeated by translation.
STUTTER_CHARS = 64


def _mask_stutter(t: Column) -> Column:
    """The mark of a last word that machine translation gave twice, mark and all."""
    word = rf"\S{{0,{STUTTER_CHARS - 1}}}[^\s.!?] ?[.!?]{{1,3}}"
    return F.regexp_replace(t, rf"[.!?](?=[ \xa0])(?<=\s({word}))(?=[ \xa0]\1(?:\s|$))", MASK)


_CLAIM = (rf"(?:\(\d{{1,3}}\)|（\d{{1,3}}）|\d{{1,3}}[.{MASK})．](?!\d)|\d{{1,3}}{_S}?[–—](?!\d)"
          rf"|[【\[]?(?:請求項|权利要求|權利要求|Claim|Anspruch){_S}?\d{{1,3}}[】\]]?[.:)：]?)")
_CLAIM = rf"(?:{_CLAIM}{_S}?){{1,2}}"  # its number may be given twice


def _hard_cuts(t: Column) -> Column:
    """Cuts at blank lines and before paragraph labels and claims."""
    back = r"[ \t\r]{0,3}\n"
    claim = (rf"(?=[ \t]*{_CLAIM}{_S}?[\p{{L}}|])(?:(?<=[.!?{_END}…;；:：{CLOSE}{_THAI}]{back})|(?<![\p{{Ll}},{MASK}]{back})(?=[ \t]*{_CLAIM}{_S}?[\p{{Lu}}\p{{Lo}}])"
             rf"|(?<=\p{{L}}{back})(?=[ \t]*\(?1[.{MASK})–—]?\)?{_S}?[–—]?{_S}?[\p{{Lu}}\p{{Lo}}]))")
    return F.regexp_replace(t, rf"\n(?:(?:[ \t\r]*\n)+|(?=[ \t]*{_LABEL})|{claim})", "$0" + HARD)


def _soft_cuts(t: Column, wrapped: Column, wide: Column, rare: Column, thai: Column) -> Column:
    """Cuts behind terminators; at line breaks too unless the text's lines are wrapped.

    Texts without wide or Thai signs are spared their patterns.
    """
    latin = rf"(?<=[.!?])[{CLOSE}]{{0,3}}(?:{_S}Â?»)?(?={_S})|(?<=[.])(?=\p{{Lu}}\p{{Ll}})(?<={_WORD_END}[.])"
    line = r"(?<=[^\s,;:，；：、؛،–—-][ \t\r]{0,3}\n)"
    ends, all_ends = rf"[{_END}]+[{CLOSE}]{{0,3}}", rf"(?:[{_END}]|[{_RARE}])+[{CLOSE}]{{0,3}}"
    # Thai: a space between two clauses (a figure or sign may stand behind the last Thai letter, 16 characters at most), not before what goes on (to, than, the value, before, and, which, comprising)
    space = rf"[{_THAI}%)\"{MASK}](?={_S}+[{_THAI}])(?!{_S}+(?:ถึง|ค่าเ|ก่อน|และ|ซึ่ง|ประกอบด้วย|ที่|โดย))(?<=[{_THAI}][^\n]{{0,16}})"

    def cut(lines: bool) -> Column:
        basic = rf"[.!?\n](?:{latin}|{line})" if lines else rf"[.!?](?:{latin})"
        put = lambda *more: F.regexp_replace(t, "|".join([basic, *more]), "$0" + CUT)
        return F.when(thai, put(all_ends, space)).when(rare, put(all_ends)).when(wide, put(ends)).otherwise(put())

    return F.when(wrapped, cut(False)).otherwise(cut(True))


def _starts(lengths: Column, block: int = 128) -> Column:
    """Exclusive prefix sums of an int array, in blocks so that very long arrays stay cheap."""
    def scan(a: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    size = F.size(lengths)
    heads = F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / block).cast("int"))
    parts = F.transform(heads, lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
    firsts = scan(sums, F.lit(0))
    return F.when(size <= block, scan(lengths, F.lit(0))).otherwise(F.flatten(F.zip_with(parts, firsts, scan)))


def sentence_units(df: DataFrame, text: str, keep: Sequence[str], with_text: bool = False) -> DataFrame:
    """One row per unit: ``keep`` columns, start_char, end_char and, if asked for, the unit's text."""
    d = df.select(*keep, F.col(text).cast("string").alias("_t")).where(F.col("_t").isNotNull())
    clean = F.when(F.col("_t").contains(CUT) | F.col("_t").contains(MASK) | F.col("_t").contains(HARD), F.translate("_t", CUT + MASK + HARD, "�" * 3)).otherwise(F.col("_t"))
    has = lambda signs: F.lit(False) if not signs else F.col("_t").contains(signs[0]) | has(signs[1:])
    d = d.withColumns({"_wide": has(_END), "_rare": F.col("_t").rlike(f"[{_RARE}]"), "_thai": F.col("_t").rlike(f"[{_THAI}]")})
    d = d.withColumn("_m", _mask_stutter(clean))
    d = d.withColumn("_m", _mask_stops(F.col("_m")))
    for opening, closing, signs in _PAIRS:
        d = d.withColumn("_m", F.when(has(signs[0]), _mask_quoted(F.col("_m"), opening, closing, signs)).otherwise(F.col("_m")))
    d = d.withColumn("_m", _mask_signs(F.col("_m"), F.col("_wide"), F.col("_rare")))
    # lines are wrapped where paragraphs stand apart by blank lines
    d = d.withColumn("_w", F.col("_m").rlike(r"\n[ \t\r]*\n"))
    d = d.withColumn("_h", _hard_cuts(F.col("_m")))
    # all of the text is cut at once; the cuts inside claims are taken back
    d = d.withColumn("_h", F.split(_soft_cuts(F.col("_h"), F.col("_w"), F.col("_wide"), F.col("_rare"), F.col("_thai")), HARD))
    claim, whole = rf"^{_S}*{_CLAIM}{_S}?[\p{{L}}|]", lambda p: F.replace(p, F.lit(CUT), F.lit(""))
    d = d.withColumn("_p", F.flatten(F.transform("_h", lambda p: F.when(whole(p).rlike(claim), F.array(whole(p))).otherwise(F.split(p, CUT)))))
    d = d.withColumn("_n", F.transform("_p", lambda p: F.length(p)))
    d = d.withColumn("_a", _starts(F.col("_n")))
    start = lambda p, n, a: a + n - F.length(F.ltrim(p, F.lit(BLANK)))
    # trimming at the right takes a look at the whole piece, so only pieces that end in a blank are trimmed
    end = lambda p, n, a: a + F.when(F.lit(BLANK).contains(F.right(p, F.lit(1))), F.length(F.rtrim(p, F.lit(BLANK)))).otherwise(n)
    units = F.transform("_p", lambda p, i: F.struct(start(p, F.get("_n", i), F.get("_a", i)).alias("start_char"), end(p, F.get("_n", i), F.get("_a", i)).alias("end_char")))
    units = F.filter(units, lambda u: u["start_char"] < u["end_char"])
    if with_text:
        d = d.select(*keep, "_t", units.alias("_u"))
        units = _with_text("_t", "_u")
    # an expression is exploded, not a column: of a column, Spark would infer a filter and compute it twice
    return d.select(*keep, F.explode(units).alias("u")).select(*keep, "u.*")


def _with_text(text: str, units: str) -> Column:
    """Adds each unit's original text.

    A substring costs as much as what lies before it, so the text is cut into about as many blocks as a block has
    units, and the units are cut out of their block.
    """
    n, u = F.size(units), F.col(units)
    block = F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("int")
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), block), lambda _: n > 0), lambda i: F.slice(u, i + 1, block))

    def cut(part: Column) -> Column:
        first = F.get(part, F.lit(0))["start_char"]
        whole = F.substring(text, first + 1, F.get(part, F.size(part) - 1)["end_char"] - first)
        one = F.array(F.struct(whole.alias("s"), part.alias("p"), first.alias("f")))  # a binding, so that the block is cut once
        return F.flatten(F.transform(one, lambda b: F.transform(b["p"], lambda x: F.struct(
            x["start_char"], x["end_char"], F.substring(b["s"], x["start_char"] - b["f"] + 1, x["end_char"] - x["start_char"]).alias("sentence")))))

    return F.flatten(F.transform(parts, cut))
