"""Documents for tests, generated from the shapes that the library judges stored documents by.

Every required field gets the least value of its type: null where it may be null, no text, zero, false,
an empty list, a generated object. Ids are named after their field, times are `NOW`, enumerated fields take
the first value of their enumeration. `made("result")` is thus valid for the shape alone; what a status
demands beyond that is added by the three builders at the end. In keyword arguments `__` goes down a level.
"""

import copy

from mediasift import vocab
from mediasift.operators.rules import SHAPES

NOW = "2031-02-03T04:05:06Z"

LEAST = {"S": "", "I": 0, "N": 0.0, "B": False, "A": []}
CHOICES = {
    "media_type": vocab.MEDIA_TYPES,
    "channel": vocab.SOURCE_CHANNELS,
    "stage": vocab.STAGES,
    "severity": vocab.SEVERITIES,
    "category": vocab.ERROR_CATEGORIES,
    "primary_action": vocab.RECOMMENDED_ACTIONS,
    "result.status": vocab.ANALYSIS_STATUSES,
    "analyzer.status": vocab.ANALYZER_STATUSES,
    "completeness.status": vocab.COMPLETENESS_STATUSES,
    "cleanup.status": vocab.CLEANUP_STATUSES,
}
#: Objects that may have one of several shapes.
CHOSEN = {"file": "validated_file", "technical_parameters": "image"}


def _least(shape, name, code):
    if code.endswith("0"):
        return None
    if code == "O":
        inner = CHOSEN.get(name, name)
        return made(inner) if inner in SHAPES else {}
    choices = CHOICES.get(f"{shape}.{name}", CHOICES.get(name))
    if choices:
        return choices[0]
    if name.endswith("_at"):
        return NOW
    return name if name.endswith("_id") else copy.copy(LEAST[code])


def changed(record, over):
    out = copy.deepcopy(record)
    for path, value in over.items():
        *levels, field = path.split("__")
        at = out
        for level in levels:
            at = at[level]
        at[field] = value
    return out


def without(record, *path):
    out = copy.deepcopy(record)
    at = out
    for level in path[:-1]:
        at = at[level]
    del at[path[-1]]
    return out


def made(shape, **over):
    """The least document of a shape, with changes."""
    fields = {name: code for name, code in SHAPES[shape].items() if not name.endswith("?")}
    return changed({name: _least(shape, name, code) for name, code in fields.items()}, over)


def validated_file(**over):
    return made("validated_file", **over)


def input_file(**over):
    return made("input_file", **over)


def analyzer(**over):
    return made("analyzer", **over)


def finding(**over):
    return made("finding", **over)


ERROR = made("error")


def result(**over):
    """Least document that rule R20 lets be `completed`: assessed whole, with a level."""
    return changed(made("result", status="completed", risk_assessment__final_level="low"), over)


def partial(**over):
    """Assessed in part, and one warning says so."""
    return changed(result(status="partial", completeness__status="partial", warnings=["w"]), over)


def rejected(**over):
    """A file that was only received, nothing assessed, one error."""
    base = made("result", status="rejected", file=input_file(), completeness__status="not_assessed", errors=[ERROR])
    return changed(base, over)
