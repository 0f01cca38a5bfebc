"""What can be proven of two types when they are composed: subtypes, meets, unions and the check of a sequence."""

from __future__ import annotations

import math

from . import matchers as M
from .nodes import (
    Any,
    Array,
    Attr,
    Capability,
    Check,
    Choice,
    Convert,
    Deferred,
    Equals,
    FilteredArray,
    FilteredMap,
    FilteredRecord,
    Gate,
    Generate,
    Interval,
    Invoke,
    Key,
    Map,
    Meet,
    Never,
    Not,
    Record,
    Refine,
    Seq,
    Static,
    Stream,
    StructOf,
    Tagged,
    Tuple,
    Type,
    TypeMismatch,
    Undefined,
    Wrap,
    matches_key,
)


def bare(t: Type) -> Type:
    """Without policies, metadata and labels."""
    while isinstance(t, Wrap):
        t = t.inner
    return t


def produced(t: Type) -> Type:
    t = bare(t)
    return t if t.preserving else bare(t.output_type)


def accepted(t: Type) -> Type:
    t = bare(t)
    if isinstance(t, (Array, Tuple, Map, Record)):
        return t.rebuilt(tuple(accepted(c) for c in t.children()))
    if isinstance(t, (FilteredArray, FilteredMap, FilteredRecord)):
        return Gate("array") if isinstance(t, FilteredArray) else Gate("hash")
    if isinstance(t, Tagged):
        return t.rebuilt(tuple(accepted(c) for c in t.variants))
    return bare(t.input_type)


def chain(t: Type) -> tuple[Type, list]:
    """The base under refinements, and the refinements."""
    tests = []
    while isinstance(t, Refine):
        tests.append(t)
        t = bare(t.base)
    return t, tests


def shapes(t: Type, opened: tuple = ()) -> list[tuple[Type, ...]]:
    """The union of conjunctions that t makes: Never has no branch, Any one without parts, a refinement is a part beside its base.

    A type that holds itself is opened once; met again before any container it adds nothing to the union.
    """
    while (made := produced(t)) != t:
        t = made
    if isinstance(t, (Any, Never)):
        return [()] * isinstance(t, Any)
    if isinstance(t, Deferred):
        return [] if t.make in opened else shapes(t.target(), (*opened, t.make))
    if isinstance(t, Choice):
        return [s for c in t.children() for s in shapes(c, opened)]
    if isinstance(t, Meet):
        return [x + y for x in shapes(t.left, opened) for y in shapes(t.right, opened)]
    if isinstance(t, Refine):
        return [(*s, t) for s in shapes(t.base, opened)]
    if isinstance(t, Tagged):
        return [s for v in t.variants for s in shapes(v, opened)]
    if isinstance(t, StructOf):
        return shapes(t.cls.schema, opened)
    return [(t,)]


#: A meet of unions with more branches than this stays a meet, which lowers to one test after another.
WIDE = 8


def conjuncts(t: Type) -> list[Type]:
    return [x for c in t.children() for x in conjuncts(c)] if type(t) is Meet else [t]


def width(t: Type) -> int:
    """How many branches shapes would have, types that hold themselves aside."""
    if isinstance(t, Choice):
        return sum(map(width, t.children()))
    if isinstance(t, Meet):
        return math.prod(map(width, t.children()))
    return width(t.base) if isinstance(t, Refine) else width(t.inner) if isinstance(t, Wrap) else len(t.variants) if isinstance(t, Tagged) else 1


def subtype(a: Type, b: Type, assumed: frozenset = frozenset()) -> bool:
    """Whether every value of a is a value of b, as far as it can be proven.

    Both are unions of conjunctions: each branch of a has to lie in one branch of b. Pairs with a type that holds itself
    are taken as proven while they are looked at. A meet of so many unions that their product is more than WIDE is not
    multiplied out: one of its parts has to lie in b.
    """
    if a == b:
        return True
    if isinstance(a, Deferred) or isinstance(b, Deferred):
        names = tuple(t.make if isinstance(t, Deferred) else id(t) for t in (a, b))
        if names in assumed:
            return True
        assumed |= {names}
    if isinstance(b, Meet):
        return all(subtype(a, c, assumed) for c in conjuncts(b))
    if isinstance(a, Meet) and width(a) > WIDE:
        return any(subtype(c, b, assumed) for c in conjuncts(a))
    wider = shapes(b)
    return all(any(all(asked in own or lies_in(own, asked, assumed) for asked in parts) for parts in wider) for own in shapes(a))


def lies_in(own: tuple[Type, ...], asked: Type, assumed: frozenset) -> bool:
    """Whether values that have all the parts of a branch have the one that is asked for."""
    if isinstance(asked, Refine):
        return any(implies(part, asked) for part in own)
    if isinstance(asked, Not):
        return any(subtype(asked.inner, part.inner, assumed) if isinstance(part, Not) else disjoint(part, asked.inner) for part in own)
    return any(part_within(part, asked, assumed) for part in own)


#: What kind of value a container is.
CONTAINERS = {Array: "array", Tuple: "array", Record: "hash", Map: "hash", Interval: "range"}


def part_within(part: Type, asked: Type, assumed: frozenset) -> bool:
    """Whether one part of a branch is enough for a type that is neither a union, a meet nor a refinement."""
    if isinstance(part, Static) and isinstance(asked, Gate):
        return M.Kind(asked.kind).matches(part.literal) is True  # the very value, not what equals it
    if isinstance(asked, (Gate, Equals, Static)) and (values := values_of(part)) is not None:
        return values.within(M.Kind(asked.kind) if isinstance(asked, Gate) else M.Equal(asked.literal)) is True
    if isinstance(asked, Capability):
        kind = part.kind if isinstance(part, Gate) else CONTAINERS.get(type(part))
        return asked.names <= part.names if isinstance(part, Capability) else kind in asked.kinds()
    if isinstance(part, Record) and isinstance(asked, Record):
        return records(part, asked, assumed)
    return (pairs := compared(part, asked)) is not None and all(subtype(x, y, assumed) for x, y in pairs)


def values_of(part: Type) -> M.Matcher | None:
    """The test that all values of a part pass, where there is one."""
    if isinstance(part, (Equals, Static)):
        return M.Equal(part.literal)
    if type(part) is Refine:
        return part.matcher
    kind = part.kind if isinstance(part, Gate) else CONTAINERS.get(type(part))
    return M.Kind(kind) if kind else None


def compared(part: Type, asked: Type) -> list[tuple[Type, Type]] | None:
    """The pairs of inner types on which it depends whether a container lies in another; None where no pair could help."""
    match part, asked:
        case (Array(), Array()) | (Interval(), Interval()) | (Stream(), Stream()):
            return [(part.of, asked.of)]
        case Tuple(), Tuple() if len(part.of) == len(asked.of):
            return list(zip(part.of, asked.of))
        case Tuple(), Array():
            return [(x, asked.of) for x in part.of]
        case Map(), Map():
            return [(part.keys, asked.keys), (part.values, asked.values)]
        case Record(), Map():
            entries = [(Equals(k.name), x) for k, x in part.fields] + list(part.typed) + ([(Any(), part.rest)] if part.rest else [])
            return [pair for k, x in entries for pair in ((k, asked.keys), (x, asked.values))]
        case Map(), Record() if not asked.fields and not asked.typed:
            return [(part.values, asked.rest)] if asked.rest else []
    return None


def records(a: Record, b: Record, seen: frozenset) -> bool:
    """Width, depth and optionality; the record without fields is above all records."""
    if not b.children():
        return True
    if not a.children():
        return False
    shut = isinstance(a.rest, Never) or a.rest is None
    for k, t in b.fields:
        own = next(((x, y) for x, y in a.fields if x.name == k.name), None)
        if own is None:
            if not k.optional or not (shut and isinstance(a.rest, Never)) and not (a.rest and subtype(a.rest, t, seen)):
                return False
        elif own[0].optional and not k.optional or not subtype(own[1], t, seen):
            return False
    for key, t in [*b.typed, *([(Any(), b.rest)] if b.rest else [])]:
        for k, own in a.fields:
            if not any(x.name == k.name for x, _ in b.fields) and matches_key(key, k.name) and not subtype(own, t, seen):
                return False
        if a.rest and not isinstance(a.rest, Never) and not subtype(a.rest, t, seen):
            return False
    return True


def implies(a: Type, test: Refine) -> bool:
    """Whether values of a pass one refinement."""
    base, own = chain(a)
    if type(test) is Check:
        return any(type(t) is Check and (t.matcher, t.message) == (test.matcher, test.message) for t in own)
    if isinstance(test, Attr):
        return any(isinstance(t, Attr) and t.name == test.name and t.matcher.within(test.matcher) for t in own)
    if isinstance(base, (Equals, Static)) and M.Equal(base.literal).within(test.matcher):
        return True
    if isinstance(base, Gate) and M.Kind(base.kind).within(test.matcher):
        return True
    return any(type(t) is Refine and t.matcher.within(test.matcher) for t in own)


def kinds(t: Type) -> set[str] | None:
    """The kinds that values of t can have; None for any."""
    base, _ = chain(produced(t))
    if isinstance(base, Gate):
        return {base.kind}
    if isinstance(base, (Equals, Static)):
        return {M.kind_of(base.literal)}
    if isinstance(base, Choice):
        own = [kinds(x) for x in base.children()]
        return None if None in own else set().union(*own)
    kind = {Array: "array", FilteredArray: "array", Tuple: "array", Record: "hash", FilteredRecord: "hash", Map: "hash", FilteredMap: "hash", Tagged: "hash", Interval: "range"}.get(type(base))
    return {kind} if kind else None


def disjoint(a: Type, b: Type) -> bool:
    """Whether no value can be of both."""
    x, y = kinds(a), kinds(b)
    if x is not None and y is not None and not any(M.is_a(i, j) or M.is_a(j, i) or M.is_a(i, "numeric") and M.is_a(j, "numeric") and (isinstance(bare(a), Equals) or isinstance(bare(b), Equals)) for i in x for j in y):
        return True
    (p, s), (q, t) = chain(bare(a)), chain(bare(b))
    left = [r.matcher for r in s if type(r) is Refine] + ([M.Equal(p.literal)] if isinstance(p, Equals) else [])
    right = [r.matcher for r in t if type(r) is Refine] + ([M.Equal(q.literal)] if isinstance(q, Equals) else [])
    return any(m.meets(n) is False for m in left for n in right)


# --- building ---------------------------------------------------------------------------------


def refined(base: Type, m: M.Matcher) -> Type:
    """base[m]: ranges and sets fold into one, an empty overlap is Never, a refinement that cannot match its base raises."""
    if isinstance(base, Never):
        return base
    if isinstance(base, Any):
        return Gate(m.name) if isinstance(m, M.Kind) else Equals(m.value) if isinstance(m, M.Equal) else Refine(base, m)
    own = kinds(base)
    if own and not isinstance(bare(base), Choice) and all(M.Kind(k).meets(m) is False for k in own if k):
        raise TypeMismatch(f"{m.message()} can never match {base!r}")
    if type(base) is Refine:
        if base.matcher.within(m):
            return base
        found = M.intersected(base.matcher, m)
        if found == M.EMPTY:
            return Never()
        if found is not None:
            return refined(base.base, found)
    if isinstance(base, Gate) and isinstance(m, M.Kind) and M.is_a(base.kind, m.name):
        return base
    if isinstance(base, Equals):
        return base if M.Equal(base.literal).within(m) else Never() if M.Equal(base.literal).within(m) is False else Refine(base, m)
    return Refine(base, m)


def with_attribute(base: Type, name: str, m: M.Matcher) -> Type:
    """base.where(name=m): bounds of one attribute fold into one."""
    if isinstance(base, Never):
        return base
    if isinstance(base, Attr) and base.name == name:
        if base.matcher.within(m):
            return base
        found = M.intersected(base.matcher, m)
        if found == M.EMPTY:
            return Never()
        if found is not None:
            return Attr(base.base, found, name)
    return Attr(base, m, name)


def composable(a: Type, b: Type) -> None:
    """Raise where what a makes is not what b takes."""
    made, taken = produced(a), accepted(b)
    if isinstance(made, Any) or isinstance(taken, Any) or isinstance(made, (Generate, Invoke)):
        return
    shut = made.closed if isinstance(made, Record) else made
    if not subtype(made, taken) and not subtype(shut, taken):
        if b.preserving and not disjoint(made, b) and isinstance(bare(b), (Refine, Choice, Record, Array, Map, Tuple, Meet, Not, Equals, Capability)):
            return  # a filter that narrows
        raise TypeMismatch(f"{a!r} gives {made!r}, but {b!r} takes {taken!r}")


def sequence(a: Type, b: Type) -> Type:
    if isinstance(a, Any):
        return b
    if isinstance(b, Any) or isinstance(a, Never):
        return a
    if isinstance(b, Never):
        return b
    if a == b and a.preserving:
        return a
    composable(a, b)
    if b.preserving and not isinstance(b, Wrap) and subtype(produced(a), b):
        return a  # b cannot fail after a
    if isinstance(a, Array) and isinstance(b, Array) and not (a.preserving and b.preserving):
        return Array(sequence(a.of, b.of))  # one pass over the elements
    if isinstance(a, Stream) and isinstance(b, Stream):
        return Stream(sequence(a.of, b.of), a.only_valid or b.only_valid)
    if a.preserving and b.preserving and not isinstance(a, Wrap) and not isinstance(b, Wrap):
        return met(a, b)
    if type(b) is Convert and b.inp.preserving and not isinstance(b.inp, (Any, Wrap)) and subtype(produced(a), b.inp):
        return Convert(a, b.out, b.fn, b.name, b.guaranteed)  # what a makes is what b takes: one check between them, not two
    if isinstance(b, Refine) and not isinstance(b, Check):
        base, tests = chain(b)
        if subtype(produced(a), base):
            out = a
            for t in reversed(tests):
                out = Attr(out, t.matcher, t.name) if isinstance(t, Attr) else Refine(out, t.matcher) if type(t) is Refine else Check(out, t.matcher, t.message)
            return out
    return Seq(a, b)


def branches(t: Type) -> list[Type]:
    return [x for c in t.children() for x in branches(c)] if isinstance(t, Choice) else [t]


def choice(a: Type, b: Type) -> Type:
    """a | b: a branch that another contains is left out, if both only filter."""
    if isinstance(a, Any) or isinstance(b, Never):
        return b if isinstance(a, Any) else a
    if isinstance(a, Never) or isinstance(b, Any):
        return b if isinstance(a, Never) else a
    kept: list[Type] = []
    for t in branches(a) + branches(b):
        if t in kept or t.preserving and any(k.preserving and subtype(t, k) for k in kept):
            continue
        if t.preserving:
            kept = [k for k in kept if not (k.preserving and subtype(k, t))]
        kept.append(t)
    out = kept[0]
    for t in kept[1:]:
        out = Choice(out, t)
    return factored(out)


def factored(t: Type) -> Type:
    """(P[m] | P[n]) keeps one test of P: sets of one base fold into one set."""
    if isinstance(t, Choice):
        a, b = t.left, t.right
        if type(a) is Refine and type(b) is Refine and a.base == b.base and isinstance(a.matcher, M.OneOf) and isinstance(b.matcher, M.OneOf):
            return Refine(a.base, M.OneOf(tuple(dict.fromkeys(a.matcher.values + b.matcher.values))))
    return t


def met(a: Type, b: Type) -> Type:
    """The type of values that pass both filters."""
    if isinstance(a, Never) or isinstance(b, Never):
        return Never()
    if isinstance(a, Any) or a == b:
        return b
    if isinstance(b, Any):
        return a
    plain = a.preserving and b.preserving and not isinstance(a, Wrap) and not isinstance(b, Wrap)
    if plain and width(a) > 1 and width(b) > 1 and width(a) * width(b) > WIDE:
        return narrowed(a, b)
    if plain and subtype(a, b):
        return a
    if plain and subtype(b, a):
        return b
    if isinstance(a, Choice) or isinstance(b, Choice):
        left, right = (a, b) if isinstance(a, Choice) else (b, a)
        parts = [met(x, right) if left is a else met(right, x) for x in branches(left)]
        out: Type = Never()
        for p in parts:
            out = choice(out, p)
        return out
    if disjoint(a, b):
        return Never()
    (p, s), (q, t) = chain(a), chain(b)
    if plain and s and t and (p == q or subtype(p, q) or subtype(q, p)) and type(a) is type(b):
        if isinstance(a, Attr) and a.name == b.name and (found := M.intersected(a.matcher, b.matcher)) is not None:
            return Never() if found == M.EMPTY else Attr(met(a.base, b.base), found, a.name)
        if type(a) is Refine and (found := M.intersected(a.matcher, b.matcher)) is not None:
            return Never() if found == M.EMPTY else Refine(met(a.base, b.base), found)
    if isinstance(a, Array) and isinstance(b, Array):
        return Array(met(a.of, b.of))
    if isinstance(a, Tuple) and isinstance(b, Tuple):
        if len(a.of) != len(b.of):
            return Never()
        parts = tuple(met(x, y) for x, y in zip(a.of, b.of))
        return Never() if any(isinstance(x, Never) for x in parts) else Tuple(parts)
    if isinstance(a, Map) and isinstance(b, Map):
        return Map(met(a.keys, b.keys), met(a.values, b.values))
    return Meet(a, b) if a.preserving and b.preserving else Seq(a, b)


def narrowed(a: Type, b: Type) -> Type:
    """The meet of two filters with many branches, as a meet of unions: parts that others are within are left out, and so are
    branches that meet no branch of another part."""
    own = conjuncts(a)
    for c in conjuncts(b):
        if any(subtype(o, c) for o in own):
            continue
        own = [o for o in own if not subtype(c, o)]
        c = pruned(c, own)
        own = [*(pruned(o, [c]) for o in own), c]
        if any(isinstance(o, Never) for o in own):
            return Never()
    left: list[Type] = []
    for c in own:  # what is left of some may lie within others now
        if not any(subtype(o, c) for o in left):
            left = [*(o for o in left if not subtype(c, o)), c]
    out = left[0]
    for c in left[1:]:
        out = met(out, c) if width(out) * width(c) <= WIDE else Meet(out, c)
    return out


def pruned(t: Type, others: list[Type]) -> Type:
    all_, kept = branches(t), [x for x in branches(t) if not any(all(disjoint(x, y) for y in branches(o)) for o in others)]
    if len(kept) == len(all_):
        return t
    out: Type = kept[0] if kept else Never()
    for x in kept[1:]:
        out = Choice(out, x)
    return out


def meet(a: Type, b: Type) -> Type:
    """a & b."""
    if isinstance(a, Record) and isinstance(b, Record):
        return record_meet(a, b)
    return met(a, b)


def record_meet(a: Record, b: Record) -> Type:
    """Keys of both, each with the meet of its types; required if either requires it. Disjoint fields: Never."""
    fields = []
    for k, t in a.fields:
        own = next(((x, y) for x, y in b.fields if x.name == k.name), None)
        if own is not None or b.rest is not None:
            other = own[1] if own else b.rest
            both = meet(t, other)
            if isinstance(both, Never) and not (k.optional and (own is None or own[0].optional)):
                return Never()
            fields.append((Key(k.name, k.optional and (own is None or own[0].optional)), both))
    if a.rest is not None:
        fields += [(k, meet(a.rest, t)) for k, t in b.fields if a.at_key(k.name) is None]
    rest = meet(a.rest, b.rest) if a.rest and b.rest else None
    return Record(tuple(fields), (), rest)


def join(a: Type, b: Type) -> Type:
    """The least type above both that is known: their choice."""
    return choice(a, b)


def equivalent(a: Type, b: Type) -> bool:
    return subtype(a, b) and subtype(b, a)


__all__ = ["Convert", "Undefined", "choice", "composable", "disjoint", "equivalent", "join", "kinds", "meet", "met", "refined", "sequence", "subtype", "with_attribute"]
