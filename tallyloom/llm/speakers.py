"""Who a speaker label means: the interviewer or the participant.

A roster of known labels is blocked by a phonetic code, so a misspelled label is
compared only with labels that sound alike. For labels outside the roster, all
transcripts tell how much they lean to a role (do they ask, and beside which known
role do they speak), and the labels of one transcript are assigned together: the
cheapest assignment by these leans that uses both roles.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Set
from difflib import SequenceMatcher
from functools import lru_cache

INTERVIEWER, PARTICIPANT = "interviewer", "participant"

#: Labels of each role, in lower case without marks. Fixed values.
ROSTER = {
    INTERVIEWER: (
        "assessor", "befrager", "befragerin", "clinician", "clinico", "clinicienne", "clinicien", "doctor", "doctora", "docteur", "doktor", "dr", "dra",
        "enqueteur", "enquetrice", "entrevistador", "entrevistadora", "examinador", "examinadora", "examinateur", "examinatrice", "examiner", "exam", "ex",
        "experimenter", "fragesteller", "int", "intervieweur", "interviewer", "interviewerin", "inv", "investigator", "investigador", "investigadora",
        "arzt", "arztin", "medico", "medica", "moderator", "nurse", "psychologist", "q", "question", "researcher", "res", "tester", "therapist", "untersucher", "untersucherin",
        "主持人", "医生", "医师", "提问者", "访谈员", "访谈者", "访问者", "询问者", "调查员", "采访人", "采访者", "问", "面试官",
    ),
    PARTICIPANT: (
        "a", "answer", "befragte", "befragter", "caller", "client", "encuestada", "encuestado", "entrevistada", "entrevistado", "interviewee", "informant",
        "paciente", "par", "part", "participant", "participante", "participante", "pat", "patient", "patiente", "patientin", "proband", "probandin", "pt", "ptcp",
        "respondent", "subj", "subject", "sujet", "sujeto", "teilnehmer", "teilnehmerin", "versuchsperson", "vp", "volunteer",
        "参与人", "参与者", "参加者", "受访人", "受访者", "患者", "病人", "答", "被试", "被访者",
    ),
}

#: Consonants that sound alike; vowels and h, w, y have no class. Fixed values.
SOUNDS = {c: str(i) for i, group in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in group}

#: A misspelling is at least this long and this like a roster label of its block.
LEAST_LETTERS, LEAST_LIKENESS = 4, 0.88


def label_key(label: str) -> str:
    """A label without case, accents, digits, marks and white space."""
    plain = unicodedata.normalize("NFKD", label).lower()
    return "".join(c for c in plain if c.isalpha())


def phonetic_code(key: str) -> str:
    """First letter and the classes of the later consonants, equal neighbours once; other scripts stand for themselves."""
    if not key or not ("a" <= key[0] <= "z"):
        return key
    out, last = key[0], SOUNDS.get(key[0], "")
    for c in key[1:]:
        sound = SOUNDS.get(c, "")
        if sound and sound != last:
            out += sound
        last = sound
    return out


def _blocks() -> tuple[dict[str, str], dict[str, list[tuple[str, str]]]]:
    known = {name: role for role, names in ROSTER.items() for name in names}
    blocks: dict[str, list[tuple[str, str]]] = {}
    for name, role in known.items():
        blocks.setdefault(phonetic_code(name), []).append((name, role))
    return known, blocks


KNOWN, BLOCKS = _blocks()


@lru_cache(maxsize=65536)
def role_of(label: str) -> str | None:
    """The role the roster gives a label: as it stands, or its likest neighbour in the phonetic block. Else None.

    A single letter counts only in upper case.
    """
    key = label_key(label)
    if len(key) == 1 and label.strip(" .").islower():
        return None
    if key in KNOWN:
        return KNOWN[key]
    if len(key) < LEAST_LETTERS:
        return None
    near = [(SequenceMatcher(None, key, name).ratio(), name, role) for name, role in BLOCKS.get(phonetic_code(key), ()) if len(name) >= LEAST_LETTERS]
    best = max(near, default=(0.0, "", None))
    return best[2] if best[0] >= LEAST_LIKENESS else None


def spelling(label: str) -> str:
    """A label without case, accents, marks and white space; unlike in its key, digits stay, for they tell speakers apart."""
    return "".join(c for c in unicodedata.normalize("NFKD", label).lower() if c.isalnum())


def lean_alone(roles: Set[str], n: int, q: int) -> float:
    """How one transcript sees a label it does not know, from 1 (interviewer) to -1: by the only known role beside it, else by its questions."""
    if len(roles) == 1:
        return 1.0 if PARTICIPANT in roles else -1.0
    return (2 * q - n) / max(1, n)


def assign_roles(labels: Mapping[str, tuple[int, int]], learned: Mapping[str, float], declared: Mapping[str, str]) -> dict[str, str]:
    """The role of each label of one transcript.

    labels: label -> utterances and questions among them. learned: by label key, how
    all transcripts see it, from 1 (interviewer) to -1; a key it lacks is judged by
    this transcript. declared: role by label key, from the transcript's own header.

    Declared and roster labels are fixed. The others, spellings of one label
    together, get the assignment of least cost that uses both roles where there are
    two labels or more; being interviewer costs the negative lean and being
    participant the lean, so at most one label gives way, the one nearest to the
    other role. A lean of 0 is a participant's. Ties: the label that asks relatively
    more here is the interviewer, then the one that comes first by name.
    """
    fixed: dict[str, str] = {}
    others: dict[str, list[str]] = {}
    for label in sorted(labels):
        role = declared.get(label_key(label)) or role_of(label)
        if role:
            fixed[label] = role
        else:
            others.setdefault(spelling(label), []).append(label)
    if not others:
        return fixed
    taken = set(fixed.values())
    ranked = []
    for same in others.values():
        n, q = (sum(labels[x][i] for x in same) for i in (0, 1))
        ranked.append((-learned.get(label_key(same[0]), lean_alone(taken, n, q)), -q / max(1, n), same))
    ranked.sort()
    roles = [INTERVIEWER if cost < 0 else PARTICIPANT for cost, *_ in ranked]
    used = taken | set(roles)
    if len(used) == 1 and (fixed or len(ranked) > 1):
        if PARTICIPANT in used:
            roles[0] = INTERVIEWER
        else:
            roles[-1] = PARTICIPANT
    return fixed | {x: role for (*_, same), role in zip(ranked, roles, strict=True) for x in same}


#: Layout of a label: one or two words that begin with a letter. Nothing that may follow is a letter, so no word gives letters back.
LABEL = r"[^\W\d_][^\W\d_.'’]*+\.?+(?:[ ][^\W\d_]++\.?+)?"
LABEL_RE = re.compile(LABEL)
