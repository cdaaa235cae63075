"""Types and constants of the corpus data model."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK_SIZE = 4096
MIN_CHUNK = 4
MIN_FIM = 64
MIN_EVAL = 64
EVAL_SAMPLES = 8
PAD_TOKEN, IGNORE = 0, -100
#: Bytes of a stored record's body, at most; dictionary ids fit one byte.
MAX_RECORD = 4 << 20
MAX_CATEGORIES = 255
DEFAULT_SAMPLES = 256
#: Offsets of the fill-in-the-middle sentinels from the vocabulary's size.
FIM_PRE, FIM_SUF, FIM_MID, FIM_END = 0, 1, 2, 3
OTHER = "OtherLanguage"
# Languages with a category of their own. The check is case-sensitive; everything else is OTHER.
CODE_LANGUAGES = (
    "Python", "JavaScript", "C++", "Java", "C", "Go", "TypeScript", "Ruby", "Rust", "PHP", "Swift", "C#", "Kotlin", "Scala", "Dart", "Objective-C", "Perl", "Lua",
    "SQL", "HTML", "CSS", "JSON", "YAML", "Markdown", "XML",
)

SAMPLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("category", T.StringType())])
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
