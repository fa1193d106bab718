"""The closed roster of voices, and how a source's rows get theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: name, native language and gender of the voices
ROSTER: tuple[tuple[str, str, str], ...] = (
    ("Prastuti", "as", "F"),
    ("Ankur", "as", "M"),
    ("Ishita", "bn", "F"),
    ("Sourav", "bn", "M"),
    ("Gwrbw", "brx", "F"),
    ("Sansuma", "brx", "M"),
    ("Preeti", "doi", "F"),
    ("Sham", "doi", "M"),
    ("Dhara", "gu", "F"),
    ("Parth", "gu", "M"),
    ("Kavya", "hi", "F"),
    ("Amit", "hi", "M"),
    ("Deepika", "kn", "F"),
    ("Adarsh", "kn", "M"),
    ("Zoon", "ks", "F"),
    ("Ishfaq", "ks", "M"),
    ("Anjali", "kok", "F"),
    ("Sandeep", "kok", "M"),
    ("Vaidehi", "mai", "F"),
    ("Madhukar", "mai", "M"),
    ("Lakshmi", "ml", "F"),
    ("Kiran", "ml", "M"),
    ("Thoibi", "mni", "F"),
    ("Chaoba", "mni", "M"),
    ("Anagha", "mr", "F"),
    ("Chinmay", "mr", "M"),
    ("Srijana", "ne", "F"),
    ("Sagar", "ne", "M"),
    ("Itishree", "or", "F"),
    ("Akash", "or", "M"),
    ("Kaur", "pa", "F"),
    ("Manpreet", "pa", "M"),
    ("Bharati", "sa", "F"),
    ("Aryaman", "sa", "M"),
    ("Phulmani", "sat", "F"),
    ("Sibu", "sat", "M"),
    ("Moomal", "sd", "F"),
    ("Rano", "sd", "M"),
    ("Anitha", "ta", "F"),
    ("Arun", "ta", "M"),
    ("Sravani", "te", "F"),
    ("Vamsi", "te", "M"),
    ("Saba", "ur", "F"),
    ("Zaid", "ur", "M"),
)
VOICES: dict[str, tuple[str, str]] = {name: (language, gender) for name, language, gender in ROSTER}

# fixed values: source -> how its rows name a voice
ASSIGNMENT: dict[str, dict] = {
    "SPRINGLab/IndicTTS_Marathi": {"by": "gender_int", "map": {"0": "Anagha", "1": "Chinmay"}},
    "ai4bharat/Rasa": {"by": "gender_str", "map": {"Female": "Anagha", "Male": "Chinmay"}},
    "SPRINGLab/IndicTTS-Hindi": {"by": "gender_int", "map": {"0": "Kavya", "1": "Amit"}},
    "SPRINGLab/IndicTTS-English": {"by": "fixed", "voice": "Amit"},
}


def roster(spark: SparkSession) -> DataFrame:
    """``name, language, gender`` of the 44 voices."""
    return spark.createDataFrame(list(ROSTER), "name string, language string, gender string")


def native_voices(language: str) -> list[str]:
    return [n for n, (l, _) in VOICES.items() if l == language]


def is_known(name: Column) -> Column:
    return F.coalesce(name.isin(*VOICES), F.lit(False))


def _lookup(index: int):
    pairs = [F.lit(x) for n, v in VOICES.items() for x in (n, v[index])]
    return F.create_map(*pairs)


def native_language(name: Column) -> Column:
    return F.element_at(_lookup(0), name)


def voice_gender(name: Column) -> Column:
    return F.element_at(_lookup(1), name)


def assigned(source: Column, gender: Column, assignment: dict[str, dict] = ASSIGNMENT, strict: bool = True) -> Column:
    """The voice of a row by its source's rule: one voice, or by gender as a number or a word.

    With ``strict`` an unknown source or gender is an error, else null.
    """
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(source, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    out = fail("no voice rule for the source ")
    word = F.initcap(F.trim(gender.cast("string")))
    for name, rule in assignment.items():
        if rule["by"] == "fixed":
            voice = F.lit(rule["voice"])
        elif rule["by"] in ("gender_int", "gender_str"):
            key = F.trim(gender.cast("string")) if rule["by"] == "gender_int" else word
            voice = F.lit(None).cast("string")
            for g, v in rule["map"].items():
                voice = F.when(key == g, F.lit(v)).otherwise(voice)
            voice = F.coalesce(voice, fail("no voice for the gender given by "))
        else:
            raise ValueError(f"unknown rule {rule['by']!r} for {name}")
        out = F.when(source == name, voice).otherwise(out)
    return out


def speaker_problem(name: Column, gender: Column) -> Column:
    """Null for a voice of the roster whose gender, if given, agrees; else why not."""
    return F.when(~is_known(name), F.lit("unknown_speaker")).when(gender.isNotNull() & (gender != voice_gender(name)), F.lit("gender_mismatch"))
