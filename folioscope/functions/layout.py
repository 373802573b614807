"""The two-dimensional layout of a printed page's text: cells, margins, staff lines, and what a cell may be."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, taken over whole: signs as which music fonts come out in text (with the private use area), letters that are such signs.
GLYPHS = "[œŒ˙∑„ÛÚÿ‰⋲ÇÈÏİ̇§îöú\\x{E000}-\\x{F8FF}]"
GLYPH_LETTERS = "^[wWbnBVcCJjUuÓÔ#&?]+$"
# Fixed values, taken over whole: voices and instruments that stand as names of parts.
PARTS = """cantus cantvs altus tenor tenore bassus basso bass bajo baixo quintus sextus septimus superius supranus discantus descantus contratenor
contretenor countertenor counter-tenor contra soprano contralto alto canto tiple triplum dessus haute-contre haute contre taille quinte treble vox voz
flute flutes flauta flautas flauto traverso recorder recorders rec blfl oboe oboes hautbois clarinete clarinet fagote bassoon fagotto horn horns corno
trumpet trumpets tromba trombone timpani sax vl vln violin violino violini violinos viola vla vc vlc cello violoncello vlne violone gamba laud lute liuto
tecla cembalo cemb hpsi harpsichord organo organ orgao continuo bc b.c. guitarra guitar cornetto parte part pars partitura score sco generale""".split()
#: Words that number or qualify a part.
BESIDE_PARTS = r"^(i{1,3}|iv|v|vi|[1-6]º?|1er|1re|2e|2nd|3e|3rd|primo|secondo|terzo|prima|seconda|primus|secundus|tertius|e|and|&|\+|in|solo|dolce|grande|basset|sopranino|[a-g]|bb|eb)$"
#: Words that are no person's: movements, forms, marks of a page.
NO_NAMES = """allegro largo adagio andante grave presto vivace moderato lento maestoso preludio prelude praeludium fuga fugue sonata sonate suite concerto sinfonia
symphony score fantasia air ayre aria pavan pavana almain allemande courante coranto sarabande gigue menuet minuet gavotte chaconne passacaglia ballata
motet motete romance canzona ricercar tiento tento toccata verso versos kyrie missa gloria credo magnificat amen sanctus agnus benedictus partita cantata
madrigal chanson villancico galliard overture ouverture march rondo rondeau variations hymn psalm salmo antiphon cancionero codex edited arranged copyright
title composer untitled duet trio quartet quintet op opus bwv no""".split()
NAME_PARTICLES = "^(de|da|do|dos|das|di|del|della|des|von|van|du|le|la|y|non|der|den)$"
APART = r"\s{2,}|[\t\r]"
CLEF, ACCIDENTALS, METRE = "[&V?B]", "[b#n]{0,6}", r"(?:[cC¢]|\d{1,2})"
#: What the rules look for, in patterns that Java and RE2 read alike.
STAFF = rf"(?:^|\s){CLEF} ?{ACCIDENTALS} ?{METRE}(?:\s|$)"
NOTE = rf"{GLYPHS}|(?:^|\s)[wW](?:\s|$)"
SUNG = r"^\p{Ll}{1,5} +- +\p{Ll}|^\p{Ll}{1,4}$|(?:\p{L}-| - ?|\p{L} ?-).*(?:-\p{L}|- )"
ANONYMOUS = r"(?i)^(an[oó]n|anonymous|anonymus|anonyme|an[oó]nimo|incertus|incerto)(?:[\s.,(-]|$)"
LIFE = r"(?i)\(\s*(?:ca?\.|fl\.?|\*|†|n\.)\s*(?:ca?\.?\s*)?[\d?]{3,4}|\(\s*(?:ca?\.\s*)?[\d?]{3,4}\??\s*[-–]|\(\s*s\.?\s*[XVI]+|\b1[4-9]\d\d\s*[-–]\s*1[4-9]\d\d\b"
EDITOR = r"(?i)^(arr\.?|arranged by|transcr\.?(?: by)?|transcribed by|edited by|ed\.|edition(?: by)?|continuo realization by) +(.+)$"
MARKED = r"(?i)^(?:harmoni[sz]ed by|composed by|by|del se[ñn]or|von|de) +(.+)$"
SOURCE = r"(?i)\b(?:fol\.? ?\d|ff?\. ?\d|pp?\. ?\d|cancionero|cancioneiro|chansonnier|codex|library|bibliot|libro de|livre de|collection|univ\.|nos\. ?\d)|\([\p{L} .]+, [\p{L} .]+, (?:ca\. )?1[4-8]\d\d\)"
DIRECTION = r"(?i)^\[?(?:simile|cresc|dim|rit|rall|a tempo|d\. ?c\.|da capo|fine|staccato|legato|tutti|forte|piano|sub)\b|[{}=]"
RIGHTS = r"(?i)©|copyright|\(c\) *\d"
WEB = r"(?i)©|copyright|www\.|https?:|\.(?:net|com|org)\b"


_BLANKS, _WORD = r"\t\n\f\r ", "[0-9A-Za-z_]"


def alike(pattern: str) -> str:
    """The pattern as RE2 reads it: Java takes accented letters for parts of a word at ``\\b``, folds only ASCII letters, and knows more blanks and ends of lines."""
    out, inside = ["(?d)"], False
    for x in re.findall(r"(?s)\\.|\(\?i\)|.", pattern):
        if x in ("[", "]"):
            inside = x == "["
        elif x == r"\s":
            x = _BLANKS if inside else f"[{_BLANKS}]"
        elif x == r"\S":
            x = f"[^{_BLANKS}]"
        elif x == r"\b":
            x = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
        elif x == "(?i)":
            x = "(?iu)"
        out.append(x)
    return "".join(out)


#: Letters that are no signs of a music font, and a word of three of them at least that is not made of letters which such a font uses; found without taking the other words apart.
_LETTER = rf"[A-Za-z[\p{{L}}&&[^{GLYPHS[1:-1]}]]]"
_ALIKE = f"[{''.join(x for x in GLYPH_LETTERS if x.isalpha())}]"
_SPOKEN = rf"(?<!{_LETTER})(?={_LETTER}{{3}}){_ALIKE}*+{_LETTER}"
#: A word of three letters or more that is no name of a part and not made of letters which a music font uses; two words of three letters or more.
_MEANING = rf"(?<!\p{{L}})(?=\p{{L}}{{3}})(?!(?i:{'|'.join(x for x in PARTS if x.isalpha())})(?!\p{{L}}))(?!{_ALIKE}++(?!\p{{L}}))"
_TWO_WORDS = r"\p{L}{3}\p{L}*+\P{L}(?s:.*?)\p{L}{3}"
#: A glyph, looked for only where a sign is not ASCII.
_GLYPH = rf"(?=[^\x00-\x7F]){GLYPHS}"
#: A text with the blanks before it: words that single blanks join.
_RUN = rf"[{_BLANKS}]*[^{_BLANKS}]+(?:[ \n\f][^{_BLANKS}]+)*+"
#: A small word that is no particle, and a word after it, before any bracket or figure that could begin what a bare name leaves out.
_PROSE = rf"^[^(0-9]*?(?<![^ ])(?!(?:{NAME_PARTICLES[2:-2]}) )[a-z]+ \p{{L}}"


def starting(signs: str, pattern: str) -> str:
    """The pattern with a look at the one sign it starts with, so that a search passes over other places at once."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flag}(?=[{signs}])(?:{pattern.removeprefix(flag)})"


def beyond_ascii(c: Column) -> Column:
    """Texts that may have glyphs, none of which is ASCII."""
    return F.octet_length(c) > F.length(c)


def trimmed(c: Column, of: Column) -> Column:
    """Without blanks of any width before and behind, as SQL's trim; ``c`` is made of the text ``of``, which has wide blanks where ``c`` has."""
    wide = beyond_ascii(of) & of.rlike(r"(?=[^\x00-\x7F])\p{Zs}")
    return F.when(wide, F.regexp_replace(c, r"\A\p{Zs}+|\p{Zs}+\z", "")).otherwise(F.trim(c))


def unquoted(c: Column) -> Column:
    """A trimmed text without quotation marks."""
    return F.when(c.contains('"') | beyond_ascii(c) & c.rlike(r"(?=[^\x00-\x7F])[“”«»]"), trimmed(F.regexp_replace(c, "[“”\"«»]", ""), c)).otherwise(c)


def staff_line(line: Column) -> Column:
    """A clef with a metre, and a note."""
    return line.rlike(alike(STAFF.replace(rf"(?:^|\s){CLEF}", rf"{CLEF}(?<![^{_BLANKS}]{CLEF})"))) & line.rlike(alike(NOTE))


def music_line(line: Column) -> Column:
    """Three glyphs or more."""
    return beyond_ascii(line) & (F.regexp_count(line, F.lit(_GLYPH)) >= 3)


def runs(line: Column) -> Column:
    """array<struct<text, start, end>>: the texts of a line that two blanks or more, or a tab, keep apart, with their places."""
    each = F.transform(F.regexp_extract_all(line, F.lit(_RUN), F.lit(0)), lambda x: F.struct(F.length(x).alias("long"), F.ltrim(x, F.lit("\t\n\f\r ")).alias("text")))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("runs"))

    def put(done: Column, x: Column) -> Column:
        end, text = done["end"] + x["long"], x["text"]
        return F.struct(end.alias("end"), F.concat(done["runs"], F.array(F.struct(text.alias("text"), (end - F.length(text)).alias("start"), end.alias("end")))).alias("runs"))

    return F.aggregate(each, none, put, lambda x: x["runs"])


def legible(c: Column) -> Column:
    """Text and not music: few glyphs, and a word of three letters that is not made of letters a music font uses."""
    glyphs = F.regexp_count(c, F.lit(_GLYPH))
    return c.rlike(_SPOKEN) & ~(beyond_ascii(c) & (glyphs > 1) & (glyphs > 0.12 * F.length(c))) & ~((c.startswith("A") | c.startswith("B")) & c.rlike(alike("^[AB]{4,}$")))


def without_glyphs(c: Column) -> Column:
    """A run's text, in which single blanks stand between words, without words of glyphs."""
    return F.when(beyond_ascii(c), trimmed(F.regexp_replace(c, alike(rf"(?:^|\s){_GLYPH}+(?=\s|$)"), ""), c)).otherwise(c)


def sung(c: Column) -> Column:
    """Syllables below music; all but the shortest have a hyphen."""
    return (F.contains(c, F.lit("-")) | (F.length(c) <= 4)) & c.rlike(alike(SUNG))


def web(c: Column) -> Column:
    return c.rlike(alike(starting("©cwh.", WEB)))


def source(c: Column) -> Column:
    # all words that follow the word boundary begin with a letter
    return c.rlike(alike(starting("fpclbun(", SOURCE.replace(r"\b(?:", f"(?<!{_WORD})(?:", 1))))


def meaning(c: Column) -> Column:
    """A word that says what the page is, not who plays it."""
    return c.rlike(_MEANING)


def two_words(c: Column) -> Column:
    return c.rlike(_TWO_WORDS)


def unbracketed(c: Column) -> Column:
    marked = c.startswith("[") | c.startswith("(") | c.endswith("]") | c.endswith(")")
    return trimmed(F.when(marked, F.regexp_replace(c, alike(r"^[\[(]\s*|\s*[\])]$"), "")).otherwise(c), c)


def part_label(c: Column) -> Column:
    """One to four words, all of them names of parts or what numbers these, one at least a name; a bracket may stand alone before and behind."""
    words = F.split(F.lower(unbracketed(c)), alike(r"\s+"))
    undotted = lambda w: F.rtrim(w, F.lit("."))
    named = lambda w: undotted(w).isin(*[p.rstrip(".") for p in PARTS])
    return ~c.rlike(rf"^(?:[^{_BLANKS}]++[{_BLANKS}]++){{6}}[^{_BLANKS}]") & (F.size(words) <= 4) & F.exists(words, named) & F.forall(words, lambda w: named(w) | undotted(w).rlike(alike(BESIDE_PARTS)))


def bare_name(c: Column) -> Column:
    """A name without dates of life, a footnote's number or a title before it."""
    bare = F.regexp_replace(c, alike(r"(?i)\s*\((?:[^)]*\d[^)]*|\s*s\.?\s*[XVI]+[^)]*)\)?\s*$"), "")
    bare = F.regexp_replace(F.regexp_replace(bare, alike(r"\s+1[4-9]\d\d\s*[-–]\s*1[4-9]\d\d.*$"), ""), alike(r"\s+\d\)\s*$"), "")
    return trimmed(F.regexp_replace(F.regexp_replace(bare, alike(r"(?i)^(?:mr|mrs|capt|sr|dr|don)\.\s+"), ""), alike(r"[\s,;:]+$"), ""), c)


def _strong(w: Column) -> Column:
    x = F.regexp_replace(w, alike(r"[.,'’]+$"), "")
    return x.rlike(alike(r"^(?:\p{Lu}'|l')?\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}?[\p{Ll}'’]+)*$")) | x.rlike(alike(r"^\p{Lu}{2,}(?:-\p{Lu}{2,})*$"))


def person(c: Column) -> Column:
    """Capitalised words, initials and particles only, none of them a word of music, and no dedication; or an anonymous."""
    no = lambda w: F.lower(F.regexp_replace(w, alike("[.,]+$"), "")).isin(*NO_NAMES, *PARTS)
    short = lambda w: w.rlike(alike(r"^\p{Lu}\.?$")) | w.rlike(alike(r"^\p{Lu}\p{Ll}{0,3}\.$"))
    small = lambda w: F.lower(F.regexp_replace(w, alike("[.,]+$"), "")).rlike(alike(NAME_PARTICLES))
    shape = lambda words: (F.size(words) <= 6) & F.forall(words, lambda w: ~no(w) & (small(w) | short(w) | _strong(w))) & F.exists(words, lambda w: ~small(w) & ~short(w) & _strong(w))
    words = lambda name: F.split(trimmed(F.regexp_replace(name, alike(r"\.(\S)"), ". $1"), name), alike(r"\s+"))
    plain = lambda name: ~name.rlike(alike(r"[\d{}=:;!?]")) & (F.length(name) <= 60) & ~name.rlike(alike(r"^(?:A|À|To|Para|Pour|Für|Al|Alla|Dedicated)\s"))
    anonymous = c.rlike(alike(r"(?i)^\p{Zs}*(?:(?:mr|mrs|capt|sr|dr|don)\.\s+)?(?:an|incert)"))
    # arrays of one, so that the name and its words are worked out once
    named = F.exists(F.array(bare_name(c)), lambda name: (name != "") & (name.rlike(alike(ANONYMOUS)) | plain(name) & F.exists(F.array(words(name)), shape)))
    return (~c.rlike(_PROSE) | anonymous) & named


def rights(page: Column) -> Column:
    """struct(holder, year) of the first line that claims rights and names a holder; the last year counts."""
    lines = F.filter(F.split(page, "\n"), lambda x: x.rlike(RIGHTS))
    rest = F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)((?:©|copyright|\(c\)).*?)(?:\s{3,}|$)", 1))
    years = lambda x: F.regexp_extract_all(x, F.lit(r"\b(1[89]\d\d|20[0-4]\d)\b"), F.lit(1))

    def holder(x: Column) -> Column:
        for pattern in (r"(?i)reference:.*$", r"(?i)©|\(c\)|copyright|all rights reserved|licensed under.*$", r"(?i)\((?:under|bajo|sob)[^)]*\)?", r"\b(?:1[89]\d\d|20[0-4]\d)\b(?:\s*[-–]\s*\b(?:1[89]\d\d|20[0-4]\d)\b)?", r"(?i)^\s*(?:by|por|de)\s+|\s+(?:by|por)\s+"):
            x = F.regexp_replace(x, pattern, " ")
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\d)]+$", ""), r"^[\s,.;:–-]+", ""), r"\s+", " "))

    named = F.transform(rest, lambda x: F.struct(F.when((holder(x) == "") & x.rlike("(?i)mutopia"), "Mutopia Project").otherwise(holder(x)).alias("holder"), F.try_element_at(years(x), F.lit(-1)).alias("year")))
    return F.get(F.filter(named, lambda r: r["holder"] != ""), F.lit(0))
