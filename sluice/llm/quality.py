"""Quality rules in SQL functions only: base counts, then line-first cleaning.

Every line is judged alone: boilerplate phrases, separators and links that are many for its words, menu words, lack
of closing punctuation in a short line, and a large share of symbols make it fail.  A long line is not failed by
a phrase or a few separators in it.  Failing lines are removed; a document that loses more than ``MAX_LOST``
of its word characters, or fails a base rule, is rejected.  Lines without a word neither fail nor count.

Defined cases: null text has no words and is rejected; ids may be null or repeat, each row is judged
alone; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import prepare

MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_LOST = 0.5
SHORT_LINE_WORDS = 4
MAX_LINE_SYMBOLS = 0.3
#: Lines with as many words for each boilerplate phrase, or each separator, are prose.
PHRASE_WORDS, SEPARATOR_WORDS = 20, 10
WHITE = r"[\\x20\\x09-\\x0D]"
# Characters that base counts take as symbols, and white space that separates words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
# Marks that close a line, separate entries of a navigation line, count as symbols of a line.
CLOSING = ".!?…:;,\"'”’»)]。！？"
SEPARATORS = "|»›•·→"
LINE_SYMBOLS = "#*$%&|<>{}=_~^@\\"
# Phrases of boilerplate lines, by language.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "accept cookies", "uses cookies", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "sign up for our newsletter", "click here to", "powered by", "skip to content", "skip to main content", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "verwendet cookies", "javascript aktivieren", "newsletter abonnieren", "klicken sie hier", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "accepter les cookies", "utilise des cookies", "activer javascript", "abonnez-vous à notre newsletter", "cliquez ici", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "aceptar cookies", "utiliza cookies", "activar javascript", "suscríbete a nuestro boletín", "haga clic aquí", "saltar al contenido",
)
# Lines that are nothing but one of these are navigation, by language.
MENU = (
    "home", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "register", "search", "menu", "next", "previous", "share", "print", "back to top", "read more", "more", "sitemap",
    "startseite", "über uns", "kontakt", "impressum", "datenschutz", "anmelden", "registrieren", "suche", "menü", "weiter", "zurück", "teilen", "drucken", "nach oben", "weiterlesen", "mehr",
    "accueil", "à propos", "connexion", "inscription", "rechercher", "recherche", "suivant", "précédent", "partager", "imprimer", "haut de page", "lire la suite", "plan du site",
    "inicio", "acerca de", "contacto", "iniciar sesión", "registrarse", "buscar", "menú", "siguiente", "anterior", "compartir", "volver arriba", "leer más", "mapa del sitio",
)
NOT_WORD = r"[^\p{L}\p{N}]*"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count(text: str, characters: str) -> str:
    """SQL for how often any of the characters occurs; replacing one at a time costs far less than a pattern."""
    return "(" + " + ".join(f"(octet_length({text}) - octet_length(replace({text}, {_quoted(c)}, ''))) / {len(c.encode())}" for c in characters) + ")"


def line_fails(line: str = "l") -> str:
    """SQL for whether the line ``line`` fails."""
    words = f"regexp_count({line}, '{WHITE.replace('[', '[^', 1)}+')"
    # The line is lower-cased once, as ``m``; its words are counted only where a phrase or two separators are there.
    phrases = " + ".join(f"(octet_length(m) - octet_length(replace(m, {_quoted(p)}, ''))) / {len(p.encode())}" for p in BOILERPLATE)
    boiler = f"(({' OR '.join(f'contains(m, {_quoted(p)})' for p in BOILERPLATE)}) AND {words} < {PHRASE_WORDS} * ({phrases}))"
    separators = _count(line, SEPARATORS)
    navigation = f"({separators} >= 2 AND {words} < {SEPARATOR_WORDS} * {separators})"
    menu = f"m rlike {_quoted('^' + NOT_WORD + '+(?:' + '|'.join(MENU) + ')' + NOT_WORD + '+$')}"
    links = f"(contains({line}, '://') AND {words} <= 2 * (octet_length({line}) - octet_length(replace({line}, '://', ''))) / 3)"
    white = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    short = f"(NOT contains({_quoted(CLOSING)}, right(trim(TRAILING '{white}' FROM {line}), 1)) AND {words} < {SHORT_LINE_WORDS})"
    signs = f"{_count(line, LINE_SYMBOLS)} > {MAX_LINE_SYMBOLS} * length({line})"
    return f"({navigation} OR {links} OR exists(array(lower({line})), m -> {menu} OR {boiler}) OR {short} OR {signs})"


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and a struct ``quality``: the base counts, ``base_failed``, ``kept`` and ``cleaned``, the text without failing lines."""
    prepare(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    has_word = f"l rlike '{WHITE.replace('[', '[^', 1)}'"
    a = docs.select(F.struct(*own).alias("own"), text.alias("t"))
    a = a.select("own", "t", F.expr(f"array_remove(split(t, '{WHITE}+'), '')").alias("w"), F.expr(f"filter(split(t, '\\n'), l -> {has_word})").alias("lines"))
    a = a.select("*", F.size("w").alias("n"), F.expr(f"filter(lines, l -> NOT {line_fails()})").alias("good"))
    a = a.select(
        "*",
        F.expr("if(n < 4, array(), transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("hashes"),
        F.expr(_count("t", SYMBOLS)).alias("n_symbols"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.when(F.size("good") < F.size("lines"), F.length(F.translate(F.array_join("good", "\n"), SPACES, ""))).alias("some_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    # Only where hashes repeat are the windows themselves sorted and neighbours compared.
    a = a.select("*", F.expr("if(size(hashes) = size(array_distinct(hashes)), null, sort_array(slice(arrays_zip(w, slice(w, 2, n), slice(w, 3, n), sequence(0, n - 1)), 1, n - 2)))").alias("windows"))
    same = " AND ".join(f"x.`{k}` = y.`{k}`" for k in ("w", "1", "2"))
    a = a.select("*", F.expr(f"if(windows is null, null, sort_array(array_distinct(flatten(zip_with(slice(windows, 1, n - 3), slice(windows, 2, n - 3), (x, y) -> if({same}, array(x.`3`, y.`3`), array()))))))").alias("places"))
    repeated = F.expr("coalesce(aggregate(zip_with(places, slice(places, 2, n), (p, q) -> least(coalesce(q - p, 3), 3)), 0, (s, x) -> s + x), 0)")
    a = a.select("*", repeated.alias("n_repeat_words"))
    failed = (F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat_words").cast("long") > int(100 * MAX_REPEATED) * F.col("n").cast("long"))
    lost = F.col("some_chars").isNotNull() & (F.col("some_chars") < (1 - MAX_LOST) * F.col("word_chars"))
    kept_lines = F.expr(f"filter(split(t, '\\n'), l -> NOT ({has_word}) OR NOT {line_fails()})")
    counts = [F.col(c).cast("long").alias(k) for c, k in (("n", "n_words"), ("word_chars",) * 2, ("n_symbols",) * 2, ("n_dup_lines",) * 2, ("n_repeat_words",) * 2)]
    clean = F.when(F.col("some_chars").isNull(), F.col("t")).otherwise(F.array_join(kept_lines, "\n"))
    # The id, which no rule can fold or move, keeps a filter on ``kept`` above these projections; below them it would repeat all their work.
    stays = ~failed & ~lost & (F.monotonically_increasing_id() >= 0)
    return a.select("own.*", F.struct(*counts, failed.alias("base_failed"), stays.alias("kept"), clean.alias("cleaned")).alias("quality"))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without failing lines."""
    judged = judge(docs, text_col).where("quality.kept")
    return judged.select(*(F.col("quality.cleaned").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
