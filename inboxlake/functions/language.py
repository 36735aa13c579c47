"""Language of a short text by word-list votes, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inboxlake.constants import BRAND_LANGS, DEFAULT_LANG

# fixed values: the letters a word is made of
LETTERS = "a-záéíóúñüçãõâêôàèìòùäöß¿¡"

# fixed values: words that vote for a language
WORDS = {
    "es": "el la que no me mi hola puedo compré compre gracias por para con una es quiero tengo cómo como "
    "acceso correo pero ya sí está del los las también hice cuando porque buenas buenos todavía aún nada "
    "pago pagué",
    "en": "the i is it to and my you this for can not have want hi hello please thanks thank bought refund "
    "access still just but any with how what need email link payment one or are was been after update",
    "pt": "não nao você voce eu obrigado obrigada quero consigo já comprei está isso pra meu minha também "
    "ainda acesso tudo tenho fazer então oi",
    "it": "il che non per sono ho grazie vorrei anche della questo ciao buongiorno buonasera ancora accesso "
    "pagato comprato mi ma come quando perché salve",
    "de": "ich nicht und das ist die der hallo danke habe bitte kann mit auf ein eine noch zugang gekauft "
    "bezahlt aber wie wann guten",
}

_EVERY = sorted({word for words in WORDS.values() for word in words.split()})

# fixed values: votes that are not one whole word
SEQUENCES = {"es": (" ¿", " ¡"), "pt": (" bom dia ", " boa tarde ", " boa noite ")}


def normalize(text: Column) -> Column:
    """Lower case, every run of non-letters as one space, one space at both ends."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{LETTERS}]+", " ")
    return F.concat(F.lit(" "), words, F.lit(" "))


def bound(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_of(members: list[str]):
    return lambda token: token.isin(members)


def votes(normalized: Column) -> Column:
    """Votes per language over normalized text, as a struct.

    A repeated word shares its separating space with its neighbour, so a run of
    n equal words has ceil(n/2) votes: every pair is folded into one word, then
    the text is split once and its tokens that are in any word set are looked up in each.
    """
    tokens = F.split(F.regexp_replace(normalized, r" (\S++) \1(?= )", " $1"), " ")

    def counted(tokens: Column) -> Column:
        fields = []
        for lang, words in WORDS.items():
            count = F.size(F.filter(tokens, _one_of(words.split())))
            for sequence in SEQUENCES.get(lang, ()):
                removed = F.length(normalized) - F.length(F.replace(normalized, F.lit(sequence)))
                count = count + (removed / len(sequence)).cast("int")
            fields.append(count.alias(lang))
        return F.struct(*fields)

    return bound(F.filter(tokens, _one_of(_EVERY)), counted)


def brand_language(brand: Column, brand_langs: dict[str, str] = BRAND_LANGS) -> Column:
    result = F
    for name, lang in brand_langs.items():
        result = result.when(brand == name, lang)
    return result.otherwise(DEFAULT_LANG)


def winner(counts: Column, default: Column) -> Column:
    """The language with strictly most votes and at least two, else the default."""
    result = F
    for lang in WORDS:
        others = [counts[other] for other in WORDS if other != lang]
        result = result.when((counts[lang] >= 2) & (counts[lang] > F.greatest(*others)), lang)
    return result.otherwise(default)


def detect_language(text: Column, brand: Column, brand_langs: dict[str, str] = BRAND_LANGS) -> Column:
    """Language of a text as one Column; text and votes are bound, so each is worked out once per row."""
    default = brand_language(brand, brand_langs)
    return bound(bound(normalize(text), votes), lambda counts: winner(counts, default))
