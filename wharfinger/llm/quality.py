"""Quality rules, line first: rules judge each line, failing lines go, and a document that
loses too much of its text goes as well.

Everything is decided within one document, so this is one pass over the table without a
shuffle. A task works on slices of SLICE_BYTES of text; rules run once for each distinct line
of a slice.

Defined results: null text is the empty text; an empty text has no words and fails the base
rules; a text of any length is judged whole, in a slice of its own; repeated rows are judged
each for itself; a null doc_id stays null; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wharfinger.llm.words import SLICE_BYTES, same, sliced, split_words, sums, texts_of, window_starts


#: What a line of a menu says, and notices that sites repeat.
MENU = "|".join((
    r"home|menu|search|log ?in|sign (?:in|up)|register|next(?: page)?|previous(?: page)?|read more|back to top|click here|skip to (?:main )?content|share (?:this|on)\b.*|follow us\b.*|about(?: us)?|contact(?: us)?",
    r"startseite|suche|anmelden|registrieren|weiterlesen|mehr erfahren|nach oben|weiter|zurück|nächste seite|vorherige seite|zum inhalt springen|teilen\b.*|folgen sie uns\b.*|über uns|kontakt|impressum|datenschutz(?:erklärung)?",
    r"accueil|recherche|rechercher|connexion|se connecter|s'inscrire|inscription|page suivante|suivant|précédent|page précédente|lire la suite|en savoir plus|haut de page|retour en haut|aller au contenu|partager\b.*|suivez-nous\b.*|à propos|qui sommes-nous|nous contacter|mentions légales",
    r"inicio|buscar|iniciar sesión|registrarse|regístrate|siguiente|anterior|página siguiente|página anterior|leer más|saber más|volver arriba|ir al contenido|saltar al contenido|compartir\b.*|síguenos\b.*|sobre nosotros|quiénes somos|contacto|contáctenos|aviso legal",
))
NOTICES = "|".join((
    r"\ball rights reserved\b|\b(?:privacy|cookie) policy\b|\bterms (?:of use|of service|and conditions)\b|\blorem ipsum\b|\benable javascript\b|\buses? cookies\b|\bsubscribe to our newsletter\b|\bpowered by \w+\s*$",
    r"\balle rechte vorbehalten\b|\bdatenschutzerklärung\b|\ballgemeine geschäftsbedingungen\b|\b(?:nutzt|verwendet|verwenden) cookies\b|\bjavascript aktivieren\b|\bnewsletter abonnieren\b",
    r"\btous droits réservés\b|\bpolitique de confidentialité\b|\bconditions (?:générales )?d'utilisation\b|\butilise des cookies\b|\bactiver javascript\b|\babonnez-vous à (?:notre|la) newsletter\b",
    r"\btodos los derechos reservados\b|\bpolítica de (?:privacidad|cookies)\b|\btérminos y condiciones\b|\b(?:utiliza|usa) cookies\b|\bactivar? javascript\b|\bsuscríbete a (?:nuestro|la) (?:boletín|newsletter)\b",
))


@dataclass(frozen=True)
class LineRules:
    """Patterns are RE2. A line fails if it lacks `ends`, or matches one of the others. Words of
    menus and boilerplate are those of English, German, French and Spanish sites."""

    ends: str = r"""[.!?…。！？:;,)\]"'”’»]\s*$"""
    shouting: str = r"(?:(?:!!|\?\?)[^!?]*){4}|(?:[#*$%&<>]{2,}[^#*$%&<>]*){4}|[!?*#=_~-]{12}"
    navigation: str = rf"(?i)^\s*(?:{MENU})[\s.!:»>]*$|(?:[^|>»·\n]{{1,40}}\s[|>»·]\s){{3}}"
    boilerplate: str = rf"(?i){NOTICES}"
    code: str = r"[{}]"
    drop_repeated: bool = True
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, lost double, base_failed boolean, kept boolean"


def measure(texts: pa.Array, rules: LineRules) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The figures of METRICS for each text, and each text's lines that pass."""
    n = len(texts)
    w = split_words(texts)
    chars = pc.utf8_length(w.vocab).to_numpy().astype(np.int64) if len(w.vocab) else np.zeros(0, np.int64)
    starts = window_starts(w.offsets, 3)
    order, first = same(np.searchsorted(w.offsets, starts, "right"), w.codes[starts], w.codes[starts + 1], w.codes[starts + 2])
    alone = first & np.append(first[1:], True)
    repeated = np.zeros(len(w.codes), bool)
    at = starts[order[~alone]]
    for k in range(3):
        repeated[at + k] = True

    lists = pc.split_pattern(texts, "\n")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    lines = flat.dictionary_encode()
    kinds, code = lines.dictionary, lines.indices.to_numpy()
    doc = np.repeat(np.arange(n), np.diff(bounds))
    has = lambda rule: pc.match_substring_regex(kinds, rule).to_numpy(zero_copy_only=False)
    worded = has(r"[^\x20\x09-\x0D]")
    fails = worded & (~has(rules.ends) | has(rules.shouting) | has(rules.navigation) | has(rules.boilerplate) | has(rules.code))
    order, first = same(doc, code)
    dup = np.zeros(len(code), bool)
    dup[order[~first]] = True
    dup &= worded[code]
    bad = fails[code] | dup if rules.drop_repeated else fails[code]
    size = pc.binary_length(kinds).to_numpy().astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
    size = np.where(worded[code], size, 0) if len(code) else size
    total = sums(size, bounds)

    out = {"n_words": w.counts, "word_chars": sums(chars[w.codes], w.offsets), "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy().astype(np.int64)}
    out |= {"n_dup_lines": sums(dup, bounds), "n_repeat_words": sums(repeated, w.offsets), "n_lines": sums(worded[code], bounds), "n_bad_lines": sums(bad, bounds)}
    out["lost"] = np.divide(sums(np.where(bad, size, 0), bounds), total, out=np.zeros(n), where=total > 0)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["lost"] <= rules.max_lost)
    left = flat.filter(pa.array(~bad))
    cleaned = pc.binary_join(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(~bad)))[bounds].astype(np.int32), left), pa.scalar("\n", pa.large_string()))
    return out, cleaned


def score_documents(docs: DataFrame, rules: LineRules = LineRules(), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id and METRICS for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, slice_bytes)):
            out, _ = measure(texts_of(b["text"]), rules)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, out.values())], ["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {METRICS}")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The kept documents, all columns, without the lines that failed; n_chars follows."""
    fields = [f.name for f in docs.schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole, slice_bytes)):
            out, cleaned = measure(texts_of(b["text"]), rules)
            kept = pa.array(out["kept"])
            cleaned, b = cleaned.filter(kept), b.filter(kept)
            new = {"text": cleaned, "n_chars": pc.utf8_length(cleaned)}
            yield pa.RecordBatch.from_arrays([new[c].cast(b.schema.field(c).type) if c in new else b[c] for c in fields], schema=b.schema)

    return docs.mapInArrow(work, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
