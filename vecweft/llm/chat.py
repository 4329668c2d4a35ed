"""Operator 1: transcripts to chats; a hidden Markov model over lines recovers the roles."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

#: Names that speakers have in transcripts. A role's own name counts too.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "q", "question", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "model", "chatbot"),
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
#: A model has states for so many roles, the most frequent ones of the turns it is fitted on.
MOST_ROLES = 16
SMOOTHING = 0.5
SURE = 5
#: Two models are fitted, and each decodes the conversations that it has not seen.
FOLDS = 2
#: Longer conversations are transcripts of so many turn numbers each.
SEGMENT = 4096

_MARKER = re.compile(r"[^\S\n]*[\[(*_#<>]{0,3}[^\S\n]*([^\W\d_]{1,20}(?:[^\S\n]?\d{1,3})?)[^\S\n]*[\])*_]{0,3}[^\S\n]*(?:>[^\S\n]*:|[:>|])[*_]{0,2}[^\S\n]?")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)]|```|>)\s")

#: How the query writes speakers: names for system, user and assistant, by a hash of the conversation. Some are not among NAMES.
STYLES = (
    ("System", "User", "Assistant"), ("SYSTEM", "Human", "AI"), ("Context", "Q", "A"), ("[system]", "[customer]", "[agent]"),
    ("Speaker 1", "Speaker 2", "Speaker 3"), ("Regie", "Gast", "Studio"), ("<narrator>", "<visitor>", "<host>"),
)
STYLE_ROLES = ("system", "user", "assistant")


def marker(line: str) -> tuple[str | None, str | None, int]:
    """The name before a line, the role it names, and where the rest of the line begins; without a marker None, None, 0."""
    found = _MARKER.match(line)
    if not found:
        return None, None, 0
    name = found[1].lower()
    return name, ROLE_OF.get(name), found.end()


def observed(transcript: str, roles: frozenset[str] = frozenset()) -> list[tuple[int, str, str, tuple[tuple[str, str], ...]]]:
    """(line's number, line, name, features) of each line that is not blank.

    A name that is in no table is described by its place among the transcript's names, in order of their first lines.
    """
    lines = transcript.split("\n")
    found, names, blank = [], {}, False
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            blank = True
            continue
        name, role, _ = marker(line)
        if role is None and name in roles:
            role = name
        if name is not None and role is None:
            names.setdefault(name, len(names))
        found.append((i, line, name, role, blank, text))
        blank = False
    out = []
    for i, line, name, role, blank, text in found:
        said = role or ("none" if name is None else f"name {min(names[name], 3)} of {min(len(names), 4)}")
        features = (
            ("marker", said),
            ("blank", str(blank)),
            ("first", str(not out)),
            ("length", str(min(len(text).bit_length(), 10))),
            ("question", str(text.endswith("?"))),
            ("item", str(bool(_ITEM.match(line)))),
        )
        out.append((i, line, name, features))
    return out


class RoleModel:
    """Log-probabilities from counts: of a state after another (``start`` at first) and of a feature's value in a state.

    A state is a role and whether a line begins a turn of it; the roles are those of the counts, MOST_ROLES at most.
    """

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        values: dict[str, set[str]] = {}
        for _, feature, value in counts:
            values.setdefault(feature, set()).add(value)
        self.total, turns = Counter(), Counter()
        for (state, feature, value), n in counts.items():
            self.total[state, feature] += n
            if feature == "next" and value.endswith("/begin"):
                turns[value.removesuffix("/begin")] += n
        self.roles = [role for role, _ in sorted(turns.items(), key=lambda t: (-t[1], t[0]))[:MOST_ROLES]] or list(STYLE_ROLES)
        self.states = [(role, begins) for role in self.roles for begins in (True, False)]
        self.counts, self.sizes = counts, {f: len(v) + 1 for f, v in values.items()}
        names = [name(s) for s in self.states]
        self.start = [self.log("start", "next", n) for n in names]
        self.after = [[self.log(a, "next", b) for b in names] for a in names]
        self.end = [self.log(n, "next", "end") for n in names]
        self.seen: dict[tuple, list[float]] = {}

    def log(self, state: str, feature: str, value: str) -> float:
        size = len(self.states) + 1 if feature == "next" else self.sizes.get(feature, 2)
        return math.log((self.counts.get((state, feature, value), 0) + SMOOTHING) / (self.total[state, feature] + SMOOTHING * size))

    def emit(self, found: tuple) -> list[float]:
        if found not in self.seen:
            self.seen[found] = [sum(self.log(name(s), f, v) for f, v in found) for s in self.states]
        return self.seen[found]

    def begins(self, said: str) -> float:
        """How many times as likely a line's marker is where turns begin as within them."""
        share = []
        for kind in ("begin", "on"):
            n, total = (sum(self.counts.get((f"{role}/{kind}", "marker", said), 0) if one else self.total[f"{role}/{kind}", "marker"] for role in self.roles) for one in (True, False))
            share.append((n + SMOOTHING) / (total + SMOOTHING * self.sizes.get("marker", 2)))
        return share[0] / share[1]

    def viterbi(self, lines: list[tuple]) -> list[int]:
        """The likeliest states; equal paths go to the state listed first."""
        if not lines:
            return []
        states = self.states
        every = range(len(states))
        # The first line begins a turn.
        best = [a + b if states[s][1] else -math.inf for s, (a, b) in enumerate(zip(self.start, self.emit(lines[0]), strict=True))]
        back = []
        for found in lines[1:]:
            emit, step, via = self.emit(found), [0.0] * len(states), [0] * len(states)
            for s in every:
                # A line that goes on has the role of the line before.
                froms = every if states[s][1] else (s - 1, s)
                score, p = max((best[p] + self.after[p][s], -p) for p in froms)
                step[s], via[s] = score + emit[s], -p
            best = step
            back.append(via)
        at = max(every, key=lambda s: (best[s] + self.end[s], -s))
        path = [at]
        for via in reversed(back):
            at = via[at]
            path.append(at)
        return path[::-1]


def name(state: tuple[str, bool]) -> str:
    return f"{state[0]}/{'begin' if state[1] else 'on'}"


def parse(transcript: str, model: RoleModel) -> list[tuple[str, str]]:
    """Turns (role, text), the text as it is but for the speaker's marker before it and line breaks after it.

    A marker is taken off if its name is the recovered role's, or if it is in no table, no line within a turn has it, and in the model
    such markers are at least SURE times as likely where turns begin as within them.
    """
    roles = frozenset(model.roles)
    lines = observed(transcript, roles)
    path = [model.states[s] for s in model.viterbi([f for *_, f in lines])]
    inside = {who for (_, _, who, _), (_, begins) in zip(lines, path, strict=True) if who is not None and not begins}
    turns: list[tuple[str, int, int]] = []
    for (i, line, who, features), (role, begins) in zip(lines, path, strict=True):
        if begins:
            known = ROLE_OF.get(who, who if who in roles else None)
            named = known == role if known else who is not None and who not in inside and model.begins(features[0][1]) >= SURE
            turns.append((role, i, marker(line)[2] if named else 0))
    if not turns:
        return []
    split = transcript.split("\n")
    ends = [i for _, i, _ in turns[1:]] + [len(split)]
    return [(role, "\n".join(split[i:end])[cut:].rstrip("\n")) for (role, i, cut), end in zip(turns, ends, strict=True)]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical chat. In texts ``<|`` becomes ``<||``, so none can pass for a delimiter; ``unrender`` takes it back."""
    return "".join(f"<|{re.sub(r'[^\w-]', '_', role)}|>\n{text.replace('<|', '<||')}<|end|>\n" for role, text in turns)


def unrender(chat: str) -> list[tuple[str, str]]:
    return [(role, text.replace("<||", "<|")) for role, text in re.findall(r"<\|([\w-]+)\|>\n(.*?)<\|end\|>\n", chat, re.DOTALL)]


def fold(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(FOLDS)).cast("int")


def fit(labelled: DataFrame) -> dict[int, RoleModel]:
    """A model for each fold, from the rows (conv_id, parts) of the others; ``parts`` is an array of (role, text) in the order of
    the turns, markers included.

    Counts are taken over all rows; what reaches the driver is one count for each fold, state and value of a
    feature, a few thousand at any size: only the MOST_ROLES most frequent roles count. Turns without a role are left out.
    """
    frequent = labelled.select(F.explode("parts").alias("p")).where("p.role is not null").groupBy(F.col("p.role").alias("role")).count()
    roles = frozenset(r["role"] for r in frequent.orderBy(F.desc("count"), "role").limit(MOST_ROLES).collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2000):
            found: Counter = Counter()
            for own, parts in zip(batch.column("fold").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                starts, role_of, text = {}, {}, ""
                for part in parts or []:
                    if (part["text"] or "").strip():
                        line = text.count("\n") + part["text"][: len(part["text"]) - len(part["text"].lstrip())].count("\n")
                        starts[line] = part["role"]
                    text += part["text"] or ""
                before, role = "start", None
                for i, _, _, features in observed(text, roles):
                    begins = i in starts
                    role = starts[i] if begins else role
                    if role not in roles:
                        continue
                    state = name((role, begins))
                    found[own, before, "next", state] += 1
                    found.update((own, state, f, v) for f, v in features)
                    before = state
                found[own, before, "next", "end"] += 1
            of, state, feature, value = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), *(pa.array(x, pa.string()) for x in (state, feature, value)), pa.array(list(found.values()), pa.int64())], ["fold", "state", "feature", "value", "n"])

    counts = labelled.select(fold(F.col("conv_id")).alias("fold"), "parts").mapInArrow(count, "fold int, state string, feature string, value string, n long")
    rows = counts.groupBy("fold", "state", "feature", "value").agg(F.sum("n").alias("n")).collect()
    models = {}
    for own in range(FOLDS):
        others: Counter = Counter()
        for r in rows:
            if r["fold"] != own:
                others[r["state"], r["feature"], r["value"]] += r["n"]
        models[own] = RoleModel(dict(others))
    return models


def parse_transcripts(transcripts: DataFrame, models: dict[int, RoleModel]) -> DataFrame:
    """conv_id, segment, n_turns, roles (array), chat (canonical text) of rows with conv_id, segment and transcript.

    Null and blank transcripts have no turns and an empty chat. A transcript is one record, of any
    length; repeated rows give the same chat each; other columns are ignored.
    """
    counts = {own: model.counts for own, model in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: RoleModel(c) for k, c in counts.items()}
        for batch in pieces_of(batches, 1000):
            turns = [parse(t or "", own[k]) for k, t in zip(batch.column("fold").to_pylist(), batch.column("transcript").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("segment"), pa.array([len(t) for t in turns], pa.int64()), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array(map(render, turns), pa.string())],
                ["conv_id", "segment", "n_turns", "roles", "chat"],
            )

    kind = dict(transcripts.dtypes)["conv_id"]
    return transcripts.select("conv_id", "segment", fold(F.col("conv_id")).alias("fold"), "transcript").mapInArrow(run, f"conv_id {kind}, segment long, n_turns long, roles array<string>, chat string")


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, parts and transcript of rows (conv_id, turn, role, text), as people paste them: speakers are named in one
    of STYLES; half of the conversations have a blank line between turns, and there a quarter of the turns name no speaker.

    Turns are ordered by turn, role and text; rows without a role name none; null texts are empty. A conversation of more than
    SEGMENT turn numbers is a transcript for each SEGMENT of them, so that no task holds all of a very long one.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    names = F.array(*(F.array(*(F.lit(n) for n in names)) for names in STYLES))
    place = F.array_position(F.array(*(F.lit(r) for r in STYLE_ROLES)), F.col("role"))
    loose = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(2)) == 0
    named = F.col("role").isNotNull() & (~loose | (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) != 0))
    speaker = F.when(place > 0, F.try_element_at(F.try_element_at(names, (style + 1).cast("int")), F.greatest(place, F.lit(1)).cast("int"))).otherwise(F.initcap("role"))
    said = F.concat(F.when(named, F.concat(speaker, F.lit(": "))).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    part = F.struct("turn", "role", said.alias("text"))
    gap = F.when(loose, "\n\n").otherwise("\n")
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(0)).cast("long").alias("segment")
    grouped = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id", segment).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    parts = F.transform("parts", lambda p: F.struct(p["role"].alias("role"), F.concat(p["text"], gap).alias("text")))
    return grouped.select("conv_id", "segment", parts.alias("parts")).withColumn("transcript", F.array_join(F.transform("parts", lambda p: p["text"]), ""))


def recover(conversations: DataFrame) -> DataFrame:
    """What the query returns: the conversations as transcripts, parsed by models fitted on others, and rendered."""
    transcripts = as_transcripts(conversations)
    return parse_transcripts(transcripts, fit(transcripts))
