"""Prompt texts assembled from profile columns. The wording is fixed; only the values vary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aphora.functions.text import join_or, language_label, length_label


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def _quoted(q: Column) -> Column:
    return F.concat(F.lit('"'), q["text"], F.lit('" ('), q["category"], F.lit(")"))


def _bulleted(q: Column) -> Column:
    return F.concat(F.lit("- "), _quoted(q))


def _number(i: Column) -> Column:
    return F.concat((i + 1).cast("string"), F.lit(". "))


def recommendation_prompt(count: Column, streak: Column, logins: Column, age: Column, categories: Column,
                          favorites: Column, personalized: Column, candidates: Column) -> Column:
    """The request for recommendations; the last three arguments are lists of structs with text and category."""
    # The wording of the request.
    return F.concat(
        F.lit("Analizează profilul utilizatorului și recomandă "), count.cast("string"),
        F.lit(" citate motivaționale care s-ar potrivi cel mai bine cu preferințele și comportamentul său.\n\n"
              "Profil utilizator:\n- Zile consecutive de login: "), streak.cast("string"),
        F.lit("\n- Total login-uri: "), logins.cast("string"),
        F.lit("\n- Vechime cont: "), age.cast("string"),
        F.lit(" zile\n- Categorii preferate: "), join_or(categories, "Necunoscute"),
        F.lit("\n\nCitate favorite anterioare:\n"), _lines(favorites, _bulleted),
        F.lit("\n\nCitate personalizate generate anterior:\n"), _lines(personalized, _bulleted),
        F.lit("\n\nCitate disponibile pentru recomandare:\n"),
        _lines(candidates, lambda q, i: F.concat(_number(i), _quoted(q))),
        F.lit("\n\nRăspunde cu numerele citatelor recomandate (din lista de citate disponibile) și o scurtă "
              "explicație pentru fiecare recomandare. Formatul răspunsului trebuie să fie:\n"
              "1. <număr citat> - <explicație>\n2. <număr citat> - <explicație>\n..."),
    )


def personalize_prompt(preferences: Column, topics: Column, style: Column, length: Column, language: Column,
                       favorite_texts: Column) -> Column:
    """The request for one personal quote; the section of favorites is left empty where there are none."""
    numbered = _lines(favorite_texts, lambda t, i: F.concat(_number(i), F.lit('"'), t, F.lit('"')))
    # The wording of the request.
    section = F.when(
        F.size(favorite_texts) > 0,
        F.concat(F.lit("Citate favorite ale utilizatorului (pentru context):\n"), numbered),
    ).otherwise("")
    return F.concat(
        F.lit("Generează un citat motivațional personalizat cu următoarele caracteristici:\n"
              "- Preferințe utilizator: "), F.array_join(preferences, ", "),
        F.lit("\n- Teme de interes: "), F.array_join(topics, ", "),
        F.lit("\n- Stil: "), style,
        F.lit("\n- Lungime: "), F.coalesce(length_label(length), F.lit("undefined")),
        F.lit("\n- Limba: "), language_label(language),
        F.lit("\n\n"), section,
        F.lit("\n\nRăspunde doar cu citatul generat, fără ghilimele sau alte explicații."),
    )


def mood_prompt(mood: Column, preferences: Column, goals: Column) -> Column:
    """The request built from a mood, preferences (written as JSON) and goals."""
    # The wording of the request.
    return F.concat(
        F.lit("Generate a personalized inspirational quote for someone who:\n- Current mood: "), mood,
        F.lit("\n- Preferences: "), F.to_json(preferences),
        F.lit("\n- Goals: "), F.array_join(goals, ", "),
        F.lit("\n- Make it uplifting and relevant to their situation."),
    )


def generation_prompt(category: Column, lang: Column, tone: str = "inspiring", max_chars: int = 120) -> Column:
    """System and user message for one quote of a category."""
    # The wording of the request.
    system = F.concat(F.lit(f"Write an original motivational quote under {max_chars} chars in "), lang,
                      F.lit(". No author names."))
    user = F.concat(F.lit("Theme: "), category, F.lit(f", Tone: {tone}"))
    return F.struct(system.alias("system"), user.alias("user"))
