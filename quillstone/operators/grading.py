"""Grading of answers and emission of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import answer_norm, answer_tokens, containment, norm_tokens, once

# Modality and dimension of each playable mechanic.
MODALITY = {"A1": "reconocimiento", "A3": "produccion_guiada", "B1": "reconocimiento", "B2": "reconocimiento", "C1": "reconocimiento", "E1": "produccion_guiada", "E3": "produccion_guiada"}
DIMENSION = {"A1": "recuperacion", "A3": "recuperacion", "B1": "recuperacion", "B2": "transferencia", "C1": "relacion", "E1": "transferencia", "E3": "transferencia"}

# Messages of feedback.
MESSAGES = {
    "acierto": "Correcto.",
    "nota_repertorio": "Esa idea no es un disparate: funciona en otros contextos. Lo que cambia acá es el criterio.",
    "nota_vinculos": "Este par admite más de un vínculo: ",
    "ambigua": "Ese término también describe a otro concepto de este material, así que no alcanza para distinguirlos. Acá se buscaba: ",
    "cerca": "Vas por buen camino, pero falta precisión. Se esperaba: ",
    "correccion": "Se esperaba: ",
    "modelo": "Compará tu respuesta con este análisis:",
    "error": "No es correcto.",
}


def same(answer: Column, expected: Column) -> Column:
    """Choice items: the answer is the expected one; a null matches only null."""
    return answer.eqNullSafe(expected)


def true_false(answer: Column, polarity: Column, compat: bool = False) -> Column:
    """True/false items: the answer says what the statement is. compat: only `no` is ever right."""
    return F.coalesce(answer == F.lit("no"), F.lit(False)) if compat else F.coalesce((answer == "si") == polarity, F.lit(False))


def accepted_type(answer: Column, types: Column) -> Column:
    """Relation items: the answer is one of the pair's types, spelling aside. types: normalised by answer_norm, once a pair."""
    return F.array_contains(types, answer_norm(answer))


def open_answer(answer: Column, gold: Column) -> Column:
    """Open answers: struct(score, correct, partial) by the share of gold words that they hold."""
    words, want = answer_tokens(answer), answer_tokens(gold)
    score = F.when(F.size(words) < 5, 0.0).when(F.size(want) == 0, 0.5).otherwise(F.round(containment(words, want), 2))
    return F.struct(score.alias("score"), (score >= 0.35).alias("correct"), F.least(F.lit(1.0), score / 0.6).alias("partial"))


def evoked(answer: Column, forms: Column) -> Column:
    """Recall items: struct(partial, correct, confidence) against the accepted forms (array)."""
    norms = F.transform(forms, lambda f: once(answer_norm(f), lambda n: F.struct(n.alias("norm"), norm_tokens(n).alias("tokens"))))

    def partial(x: Column) -> Column:
        a, words = x["a"], x["words"]
        exact = F.exists(x["forms"], lambda f: f["norm"] == a)
        inside = F.exists(x["forms"], lambda f: (f["norm"] != "") & (a != "") & (F.contains(f["norm"], a) | F.contains(a, f["norm"])))
        shares = F.transform(x["forms"], lambda f: containment(words, f["tokens"]))
        best = once(F.coalesce(F.array_max(shares), F.lit(0.0)), lambda s: F.when(s >= 0.6, 0.7).when(s >= 0.35, 0.4).otherwise(0.0))
        return F.when(a == "", 0.0).when(exact, 1.0).when(inside, 0.85).otherwise(best)

    given = once(answer_norm(answer), lambda a: F.struct(a.alias("a"), norm_tokens(a).alias("words"), norms.alias("forms")))
    return once(once(given, partial), lambda p: F.struct(p.alias("partial"), (p >= 0.7).alias("correct"), F.when(p == 1.0, 0.85).otherwise(0.6).alias("confidence")))


def signals(mechanic: Column, concept: Column, pair: Column, correct: Column, partial: Column, repertoire: Column, confused: Column, hints: Column, duration: Column) -> Column:
    """Signals of one graded answer: array of struct(dimension, forma, target, targets, delta, latency)."""
    from quillstone.operators.profile import lookup

    edge = mechanic == "C1"
    one = lambda c: F.array(c)
    no_delta, no_latency = F.lit(None).cast("double"), F.lit(None).cast("long")

    def row(dimension, forma, target, targets, delta, latency) -> Column:
        return F.struct(dimension.alias("dimension"), F.lit(forma).alias("forma"), target.alias("target"), targets.alias("targets"), delta.alias("delta"), latency.alias("latency"))

    skill = F.when(correct.isNotNull(), row(lookup(mechanic, DIMENSION, None), "escalar", F.when(edge, "arista").otherwise("concepto"), F.when(edge, pair).otherwise(one(concept)), F.round((partial - 0.5) * 0.4, 3), no_latency))
    anchor = F.when(repertoire.isNotNull(), row(F.lit("anclaje"), "observacional", F.lit("repertorio"), one(repertoire), no_delta, no_latency))
    mixed = F.when(confused.isNotNull() & (confused != concept), row(F.lit("relacion"), "escalar", F.lit("arista"), F.array(concept, confused), F.lit(-0.1), no_latency))
    timed = F.when(mechanic.isin("A1", "A3", "C1") & (duration > 0) & (hints == 0), row(F.lit("automatizacion"), "temporal", F.lit("concepto"), one(concept), no_delta, duration.cast("long")))
    helped = F.when(hints > 0, row(F.lit("srl_accion"), "observacional", F.lit("sesion"), F.array().cast("array<string>"), no_delta, no_latency))
    return F.array_compact(F.array(skill, anchor, mixed, timed, helped))


def feedback(mode: Column, mechanic: Column, result: Column, distractor: Column, item: Column) -> Column:
    """What a student is told: struct(kind, message, works_where, answer, model, note); null in an evaluation.

    result: struct(correct, partial, ambiguous); distractor: the chosen one, struct(repertoire_id, feedback, works_where);
    item: struct(explanation, answers, accepted, model). A null result counts as wrong; what a kind lacks is null.
    """
    m, none = {k: F.lit(x) for k, x in MESSAGES.items()}, F.lit(None).cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))
    filled = lambda c: F.length(text(c)) > 0

    def told(kind: str, message: Column, works_where=none, answer=none, model=none, note=none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"), works_where.alias("works_where"), answer.alias("answer"), model.alias("model"), note.alias("note"))

    answers = F.coalesce(item["answers"], F.array().cast("array<string>"))
    several = F.when(F.size(answers) > 1, F.concat(m["nota_vinculos"], F.array_join(answers, ", "), F.lit("."))).otherwise("")
    expected = F.coalesce(F.get(item["accepted"], F.lit(0)), F.lit("—"))
    recalled = F.when(result["ambiguous"], told("ambigua", F.concat(m["ambigua"], expected))).when(result["partial"] >= 0.35, told("cerca", F.concat(m["cerca"], expected))).otherwise(told("correccion", F.concat(m["correccion"], expected)))
    wrong = (
        F.when(filled(distractor["repertoire_id"]), told("repertorio", text(distractor["feedback"]), works_where=text(distractor["works_where"]), note=m["nota_repertorio"]))
        .when(filled(distractor["feedback"]), told("distincion", distractor["feedback"]))
        .when(mechanic == "C1", told("explicacion", text(item["explanation"]), answer=F.array_join(F.filter(answers, filled), ", "), note=several))
        .when(mechanic == "A3", recalled)
        .when(mechanic.isin("E1", "E3"), told("modelo", m["modelo"], model=text(item["model"])))
        .otherwise(told("error", m["error"]))
    )
    return F.when(~mode.eqNullSafe(F.lit("evaluacion")), F.when(result["correct"], told("acierto", m["acierto"])).otherwise(wrong))
