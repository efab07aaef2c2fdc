"""Fixed word lists and patterns."""

from __future__ import annotations

# Common English function words, dropped before phrases are formed.
ENGLISH_STOP_WORDS = """
a about above after again against all also am an and any are as at be because been
before being below between both but by can could did do does doing down during each
few for from further had has have having he her here hers herself him himself his how
i if in into is it its itself just may me might more most must my myself no nor not now
of off on once only or other our ours ourselves out over own same she should so some
such than that the their theirs them themselves then there these they this those
through to too under until up upon very was we were what when where which while who
whom why will with would you your yours yourself yourselves
""".split()

# Frequent function words per language, for language identification.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when".split(),
    "fr": "le la les de des du et est un une que qui dans pour pas sur avec ce il elle au en ne se plus par son sont ou nous".split(),
    "de": "der die das und ist nicht ein eine zu von mit sich auf den dem des im es auch als an werden aus er hat dass sie nach bei um".split(),
    "es": "el la los las de del y es un una que en por con no se su para al lo como más pero sus le ya o este sí porque".split(),
}

# Patterns whose effect must be the same as in the system this re-expresses.
MARKUP = r"<[^<]+?>|\*|\n|\s{2,}"
URL = r"https?:\/\/\S+"
EXTRACTION_TEXT = r"[^a-zA-Z0-9- .,!?]"
BRACKET_GROUPS = r"\[.*?\]|\(.*?\)|\{.*?\}"
KEYWORD_LETTERS = r"[^a-zA-Z- ]"
ALPHANUMERIC = r"[^a-zA-Z0-9 ]"
DICTIONARY_TEXT = r"[^a-z]+"
DIGITS_PUNCTUATION = r"[0-9!-/:-@\[-`{-~]+"
TFIDF_TOKEN = r"\b\w\w+\b"

# Body markers and size limits of the full-text gate.
BODY_MARKERS = ("abstract", "introduction")
SHORTEST_WORD = 3
LONGEST_KEPT_WORD = 29
LONGEST_ALLOWED_WORD = 30
MIN_TEXT_WORDS = 100
MIN_ABSTRACT_WORDS = 10
MIN_KEYWORD_CHARS = 3
MIN_SAMPLE_CHARS = 20

# Sources in order of precedence, and the thresholds used with them.
SOURCE_PRECEDENCE_CORE = ("cso", "task", "method")
SOURCE_PRECEDENCE_EXTENDED = ("cso", "method", "task")
SCORE_THRESHOLD = 0.1
NEGATIVE_MAX_HITS = 3
NEGATIVE_MIN_FREQUENCY = 7
PLOT_MIN_TOTAL = 0.01
PLOT_MAX_MEAN = 0.9
