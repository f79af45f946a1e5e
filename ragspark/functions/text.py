"""Scalar text functions as Spark columns, evaluated in the JVM."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and the letters left when their marks go.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"
#: Court prefixes that join their number in a token.
COURTS = "su|stc|stl|sl|sp|sc|ac|au|c|t"
#: Code abbreviations and the full names that replace them, in order.
ABBREVIATIONS = (
    (r"(?<![\w.])(?:CST|C\.S\.T\.?)(?!\w)", "Código Sustantivo del Trabajo"),
    (r"(?<![\w.])(?:CGP|C\.G\.P\.?)(?!\w)", "Código General del Proceso"),
    (r"(?<![\w.])CPACA(?!\w)", "Código de Procedimiento Administrativo y de lo Contencioso Administrativo"),
    (r"(?<![\w.])(?:CPTSS|CPT|C\.P\.T\.(?:\s?y\s?S\.S\.)?)(?!\w)", "Código Procesal del Trabajo y de la Seguridad Social"),
    (r"(?<![\w.])(?:CPP|C\.P\.P\.?)(?!\w)", "Código de Procedimiento Penal"),
    (r"(?<![\w.])(?:C\.\s?Co\.|C\.\s?de\s?Co\.)(?!\w)", "Código de Comercio"),
    (r"(?<![\w.])E\.T\.(?!\w)", "Estatuto Tributario"),
)
#: Words before a full stop that does not end a sentence.
NO_END = (
    r"(?i)(?:(?<![\p{L}\p{N}_])(?:arts?|art[ií]culos?|n[oº°]|núm|num|nums|inc|incs|lit|lits|par|parág|ord|cfr|ss|sr|sra|dr|dra"
    r"|ibíd|ibid|op|cit|pág|págs|pp|vol|cap|tít|dcto|decr|res|sent|mag|al)|(?<![\p{L}\p{N}_])[A-ZÁÉÍÓÚ])\.$"
)
#: Phrases that speak of the evidence, and what replaces each.
META_PHRASES = (
    (r"(?iU)\b(?:seg[uú]n|de acuerdo con|conforme a|con base en|a partir de)\s+(?:la|las|los|el)\s+(?:evidencia|pasajes?|fragmentos?|textos?|documentos?)"
     r"(?:\s+(?:recuperad|proporcionad|entregad|disponib|suministrad|presentad|citad)\w*)?\s*,?\s*", " "),
    (r"(?iU)\s*,?\s*(?:como|tal como)\s+(?:se\s+)?(?:menciona|indica|señala|establece|observa|aparece|muestra)\w*\s+en\s+(?:la|el|los)\s+"
     r"(?:evidencia|pasajes?|encabezado|fragmentos?)(?:\s*\[?\d+\]?)?(?:\s+de\s+la\s+evidencia)?", ""),
    (r"(?i)\s*\((?:pasajes?|evidencia|fragmentos?)\s*\[?\d+(?:\s*[,y]\s*\d+)*\]?\)", ""),
    (r"\s*\[\d+(?:\s*[,-]\s*\d+)*\]", ""),
    (r"\s+([,.;:])", "$1"),
    (r"\s{2,}", " "),
)
#: Months of Spanish long dates.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def strip_accents(c: Column) -> Column:
    """Letters without their marks; ñ becomes n."""
    return F.translate(c, ACCENTED, PLAIN)


def norm(c: Column) -> Column:
    """Lower case without accents, white space collapsed; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "))


def token_text(c: Column) -> Column:
    """Lower case without accents but with ñ; ordinals glued, court numbers and dotted numbers joined by ``_``."""
    keep = [(a, b) for a, b in zip(ACCENTED, PLAIN, strict=True) if a not in "ñÑ"]
    low = F.translate(F.lower(c), "".join(a for a, _ in keep), "".join(b for _, b in keep))
    low = F.regexp_replace(low, r"(?U)(\d)[oº°ª]\b", "$1")
    low = F.regexp_replace(low, rf"(?U)\b({COURTS})\s*-\s*(\d+)\b", "$1_$2")
    return F.regexp_replace(low, r"(?<=\d)[.\-](?=\d)", "_")


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Word tokens of ``token_text``, in order with repeats, without ``stop_words``."""
    found = F.regexp_extract_all(token_text(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def sentence_pieces(c: Column) -> Column:
    """Raw cuts after . ! ? and white space."""
    return F.filter(F.split(F.trim(c), r"(?U)(?<=[.!?])\s+"), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences: a cut after an abbreviation or an initial is undone."""
    def add(acc: Column, piece: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last, piece)))
        grown = F.when(last.rlike(NO_END), joined).otherwise(F.concat(acc, F.array(piece)))
        return F.when(F.size(acc) == 0, F.array(piece)).otherwise(grown)

    pieces = sentence_pieces(F.coalesce(c, F.lit("")))
    return F.transform(F.aggregate(pieces, F.array().cast("array<string>"), add), lambda p: F.trim(p))


def capped(parts: Column, max_sentences: int, max_words: int) -> Column:
    """Leading sentences within both limits; the first always stays."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.array().cast("array<string>").alias("kept"))

    def add(s: Column, part: Column) -> Column:
        words = s["words"] + word_count(part)
        ok = (s["n"] == 0) | ((s["n"] < max_sentences) & (words <= max_words))
        return F.struct((s["n"] + 1).alias("n"), words.alias("words"), F.when(ok, F.concat(s["kept"], F.array(part))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(parts, state, add, lambda s: s["kept"])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def expand_abbreviations(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), ABBREVIATIONS, c)


def without_meta_phrases(c: Column) -> Column:
    """A text without talk of its evidence, sentences beginning with a capital again."""
    bare = F.trim(reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), META_PHRASES, c))
    parts = F.split(bare, r"(?<=[.!?]\s)")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def spanish_date(c: Column) -> Column:
    """ISO date of the first "12 de mayo de 2020" in a text, null if none."""
    low = norm(c)
    rule = rf"(\d{{1,2}}) de ({'|'.join(MONTHS)}) (?:de|del) (\d{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, rule, 2))
    day, year = F.regexp_extract(low, rule, 1).try_cast("int"), F.regexp_extract(low, rule, 3).try_cast("int")
    return F.when(month > 0, F.make_date(year, month.cast("int"), day))


def strip_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)


#: Spanish stop words (lower case, without accents but with ñ).
STOP_WORDS = frozenset(
    "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era erais eran eras eres es esa esas ese "
    "eso esos esta estaba estado estamos estan estar estas este esto estos estoy fue fueron fui ha habia han has hasta hay he la las le les lo los mas me mi mis mucho "
    "muchos muy nada ni no nos nosotros nuestra nuestras nuestro nuestros o os otra otras otro otros para pero poco por porque que quien quienes se sea sean ser si sido "
    "sin sobre sois somos son soy su sus suya suyas suyo suyos tambien tanto te tenia tiene tienen todo todos tu tus un una uno unos vosotros y ya yo".split()
)

#: Spanish endings of the published Snowball algorithm, by step.
_VOWELS = "aeiouáéíóúü"
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir", "ando": "ando", "iendo": "iendo", "ar": "ar", "er": "er", "ir": "ir"}
_SUFFIXES = {
    "": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    "ic": "adora ador ación acion adoras adores aciones ante antes ancia ancias", "log": "logía logías", "u": "ución uciones", "ente": "encia encias",
    "amente": "amente", "mente": "mente", "idad": "idad idades", "iva": "iva ivo ivas ivos",
}
_STEP_OF = {ending: step for step, endings in _SUFFIXES.items() for ending in endings.split()}
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERBS = (
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás "
    "iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er "
    "ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    def after(start: int) -> int:
        return next((i + 1 for i in range(start + 1, len(word)) if word[i] not in _VOWELS and word[i - 1] in _VOWELS), len(word))

    def first(start: int, vowel: bool) -> int:
        return next((i + 1 for i in range(start, len(word)) if (word[i] in _VOWELS) == vowel), len(word))

    r1 = after(0)
    if len(word) < 3:
        rv = len(word)
    elif word[1] not in _VOWELS:
        rv = first(2, True)
    else:
        rv = first(2, False) if word[0] in _VOWELS else 3
    return rv, r1, after(r1)


def _longest(word: str, endings, start: int = 0) -> str | None:
    """The longest ending of the word that lies wholly from ``start`` on."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _longest(word, _PRONOUNS, rv)
    if not pronoun:
        return word
    base = word[: -len(pronoun)]
    verb = _longest(base, _GERUNDS, rv)
    if verb:
        return base[: -len(verb)] + _GERUNDS[verb]
    return base if base.endswith("uyendo") and len(base) - 5 >= rv else word


def _without_suffix(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, _STEP_OF)
    step = _STEP_OF.get(ending)
    if step is None or len(word) - len(ending) < (r1 if step == "amente" else r2):
        return word
    base = word[: -len(ending)]

    def also(base: str, *endings: str) -> str:
        more = _longest(base, endings)
        return base[: -len(more)] if more and len(base) - len(more) >= r2 else base

    match step:
        case "" | "ic":
            return also(base, "ic") if step else base
        case "log" | "u" | "ente":
            return base + step
        case "amente":
            more = _longest(base, ("iv", "os", "ic", "ad"))
            shorter = also(base, more) if more else base
            return also(shorter, "at") if more == "iv" and shorter != base else shorter
        case "mente":
            return also(base, "ante", "able", "ible")
        case "idad":
            return also(base, "abil", "ic", "iv")
    return also(base, "at")


def _without_verb(word: str, rv: int) -> str:
    ending = _longest(word, _Y_VERBS, rv)
    if ending and word[: -len(ending)].endswith("u"):
        return word[: -len(ending)]
    ending = _longest(word, _VERBS, rv)
    if not ending:
        return word
    base = word[: -len(ending)]
    return base[:-1] if ending in ("en", "es", "éis", "emos") and base.endswith("gu") else base


def stem(word: str) -> str:
    """Spanish stem of a lower-case word by the published Snowball rules; words with other than letters stay."""
    if not word.isalpha():
        return word
    rv, r1, r2 = _regions(word)
    word = _without_pronoun(word, rv)
    shorter = _without_suffix(word, r1, r2)
    word = shorter if shorter != word else _without_verb(word, rv)
    residual = _longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if residual:
        word = word[: -len(residual)]
        if residual in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(str.maketrans("áéíóú", "aeiou"))


def stemmed(terms: DataFrame, term: str) -> DataFrame:
    """``terms`` with ``stem``: each distinct term is stemmed once and joined back."""
    vocabulary = terms.select(term).distinct()
    stems = vocabulary.withColumn("stem", F.pandas_udf(_stem_all, "string")(F.col(term)))
    return terms.join(stems, term, "left")


def _stem_all(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_lists(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    for words in lists:
        for w in words if words is not None else ():
            if w not in known:
                known[w] = stem(w)
    return lists.map(lambda words: None if words is None else [known[w] for w in words])


def index_terms(c: Column) -> Column:
    """What the lexical index holds of a text: tokens without stop words, words of letters alone as their stems."""
    return F.pandas_udf(stem_lists, "array<string>")(tokens(F.coalesce(c, F.lit("")), sorted(STOP_WORDS)))


_ORDINAL, _COURT, _JOINED = re.compile(r"(\d)[oº°ª]\b"), re.compile(rf"\b({COURTS})\s*-\s*(\d+)\b"), re.compile(r"(?<=\d)[.\-](?=\d)")
_TO_PLAIN = str.maketrans({a: b for a, b in zip(ACCENTED, PLAIN, strict=True) if a not in "ñÑ"})


def roots(text: str | None, stems: dict[str, str] | None = None) -> list[str]:
    """``index_terms`` of one text, for rules that run row by row; ``stems`` keeps those of words met before."""
    low = _COURT.sub(r"\1_\2", _ORDINAL.sub(r"\1", (text or "").lower().translate(_TO_PLAIN)))
    words = [w for w in re.findall(r"[^\W]+", _JOINED.sub("_", low)) if w not in STOP_WORDS]
    stems = {} if stems is None else stems
    for w in words:
        if w not in stems:
            stems[w] = stem(w)
    return [stems[w] for w in words]


def clean(c: Column) -> Column:
    """Abbreviations written out, talk of the evidence gone; null counts as empty."""
    return without_meta_phrases(expand_abbreviations(F.coalesce(c, F.lit(""))))


def joined_parts(parts: Column) -> Column:
    """Parts that are not empty, one space between."""
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " ")


def semicolons_to_sentences(c: Column) -> Column:
    """Every semicolon before a word ends a sentence, and a full stop ends the text."""
    parts = F.split(c, r"(?U);\s+(?=\w)")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    out = F.rtrim(F.array_join(F.concat(F.slice(parts, 1, 1), rest), ". "))
    return F.when((out != "") & ~F.substring(out, -1, 1).isin(*'.!?»"'), F.concat(out, F.lit("."))).otherwise(out)


def overlap(a: Column, b: Column) -> Column:
    """Share and number of the distinct terms of ``a`` that ``b`` holds."""
    n = F.size(F.array_intersect(a, b))
    return F.struct(F.coalesce(F.try_divide(n, F.size(F.array_distinct(a))), F.lit(0.0)).alias("share"), n.alias("n"))


def keywords(question: Column, n: int = 5) -> Column:
    """The first words of five letters or more with a root that has not come before."""
    words = F.regexp_extract_all(question, F.lit("([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{5,})"), F.lit(1))
    return F.pandas_udf(_first_roots(n), "array<string>")(F.coalesce(words, F.array().cast("array<string>")))


def first_of_roots(words, n: int) -> list[str]:
    """Lower-cased words whose root is new, the first ``n``; a stop word has no root."""
    found: dict[str, str] = {}
    for w in words:
        for root in roots(w)[:1]:
            found.setdefault(root, w.lower())
    return list(found.values())[:n] or ["norma aplicable"]


def _first_roots(n: int):
    return lambda lists: lists.map(lambda words: first_of_roots(words, n))


def clean_spaces(c: Column) -> Column:
    """Any white space, hard spaces too, as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\u00A0\u200B\uFEFF]+", " "))


def repaired_symbols(c: Column) -> Column:
    """Letters that a symbol font put into the private area U+F020 to U+F07E, as themselves."""
    private = "".join(chr(0xF000 + i) for i in range(0x20, 0x7F))
    return F.translate(c, private, "".join(chr(i) for i in range(0x20, 0x7F)))


def repaired_encoding(c: Column) -> Column:
    """UTF-8 that was read as Windows-1252 ("Ã³"), as it was; a text that does not turn out whole stays."""
    again = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    return F.when(c.rlike("[ÃÂ][\u0080-\u00BF]") & ~c.rlike("[^\u0000-\u00FF]"), again).otherwise(c)
