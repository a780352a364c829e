"""Fields of documents: their registry, options and configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field as _field, replace

INDENTS = ((2, 8), (2, 8))
_ON, _OFF = {"true", "on", "yes"}, {"false", "off", "no"}
_QUOTE = dict.fromkeys(_ON, "auto") | dict.fromkeys(_OFF | {"never"}, "never") | dict.fromkeys(("always", "force", "forced"), "always")


@dataclass(frozen=True)
class Field:
    """A field; ``defined`` tells which settings a configuration gave."""

    id: int
    name: str
    weight: float = 1.0
    break_words: bool = True
    index: bool = True
    quote: str = "auto"
    indents: tuple[tuple[int, int], tuple[int, int]] = INDENTS
    defined: frozenset[str] = _field(default=frozenset(), compare=False)


def _options(text: str) -> dict:
    """Settings of a style string such as ``word-break: off; quote: always``."""
    out: dict = {}
    for part in filter(str.strip, text.split(";")):
        key, colon, value = (x.strip() for x in part.partition(":"))
        if not colon or " " in value:
            raise ValueError(f"invalid field option {part!r}")
        if key in ("word-break", "index") and value in _ON | _OFF:
            out["break_words" if key == "word-break" else "index"] = value in _ON
        elif key == "quote" and value in _QUOTE:
            out["quote"] = _QUOTE[value]
        else:
            raise ValueError(f"invalid field option {part!r}")
    return out


def _indents(given) -> tuple[tuple[int, int], tuple[int, int]]:
    if not isinstance(given, Mapping):
        raise ValueError("'indents' must be a structure")
    sides = {"lower": INDENTS[0], "upper": INDENTS[1]}
    for key, bounds in given.items():
        side = {"l": "lower", "h": "upper"}.get(key, key)
        if side not in sides or not isinstance(bounds, Mapping) or not bounds.keys() <= {"min", "max"} or not all(isinstance(v, int) and v >= 0 for v in bounds.values()):
            raise ValueError(f"invalid 'indents': {key}")
        sides[side] = (bounds.get("min", sides[side][0]), bounds.get("max", sides[side][1]))
    return sides["lower"], sides["upper"]


class Fields:
    """Fields by name and id. Ids count from 0 in the order of registration."""

    def __init__(self, items: Iterable[Field] = ()):
        self._by_name = {f.name: f for f in items}

    def __iter__(self):
        return iter(sorted(self._by_name.values(), key=lambda f: f.id))

    def __len__(self) -> int:
        return len(self._by_name)

    def get(self, key: str | int) -> Field | None:
        if isinstance(key, str):
            return self._by_name.get(key)
        return next((f for f in self._by_name.values() if f.id == key), None)

    def add(self, name: str, **settings) -> Field:
        """The field of that name, registered if it is new."""
        if name not in self._by_name:
            used = {f.id for f in self._by_name.values()}
            number = settings.pop("id", next(i for i in range(len(used) + 1) if i not in used))
            if number in used:
                raise ValueError(f"two fields with id {number}")
            self._by_name[name] = Field(number, name, **settings)
        return self._by_name[name]

    def options_of(self, name: str) -> Field:
        """Settings for snippets: of the field, else of ``default_field``, else the defaults."""
        return self.get(name) or self.get("default_field") or Field(-1, "", indents=((2, 8), (4, 8)))

    def ids(self, names: Iterable[str]) -> list[int]:
        """A set of fields as sorted ids; unknown names are left out."""
        return sorted({f.id for n in names if (f := self.get(n))})

    @classmethod
    def load(cls, config, key: str = "fields") -> Fields:
        """From a list of field structures, or a structure that has one under key; ValueError for any other shape."""
        if config is None:
            return cls()
        items = config.get(key, []) if isinstance(config, Mapping) else config
        if not isinstance(items, (list, tuple)):
            raise ValueError(f"{key!r} must be an array of structures")
        out = cls()
        for item in items:
            if not isinstance(item, Mapping) or not isinstance(item.get("name"), str) or not item["name"]:
                raise ValueError("a field must be a structure with a name")
            settings: dict = {}
            for k, v in item.items():
                number = isinstance(v, (int, float)) and not isinstance(v, bool)
                if k == "id" and isinstance(v, int) and number and v >= 0:
                    settings["id"] = v
                elif k == "weight" and number:
                    settings["weight"] = float(v)
                elif k == "options" and isinstance(v, str):
                    settings |= _options(v)
                elif k == "indents":
                    settings["indents"] = _indents(v)
                elif k != "name":
                    raise ValueError(f"invalid field setting {k!r}")
            if out.get(item["name"]):
                raise ValueError(f"two fields named {item['name']!r}")
            out.add(item["name"], **settings, defined=frozenset(settings))
        return out

    def save(self) -> list[dict]:
        """What load takes to make the same fields."""
        out = []
        for f in self:
            item: dict = {"name": f.name, "id": f.id}
            if "weight" in f.defined:
                item["weight"] = f.weight
            styles = [f"word-break: {'on' if f.break_words else 'off'}"] * ("break_words" in f.defined) + [f"index: {'on' if f.index else 'off'}"] * ("index" in f.defined)
            styles += [f"quote: {({'auto': 'on', 'never': 'off', 'always': 'always'})[f.quote]}"] * ("quote" in f.defined)
            if styles:
                item["options"] = "; ".join(styles)
            if "indents" in f.defined:
                item["indents"] = {side: {"min": a, "max": b} for side, (a, b) in zip(("lower", "upper"), f.indents)}
            out.append(item)
        return out

    def join(self, other: Fields) -> Fields:
        """Both together; of a field in both, only what the other defines is changed. Ids must agree where defined."""
        out = Fields(self)
        for f in other:
            mine = out.get(f.name)
            if mine is None:
                out.add(f.name, **{k: getattr(f, k) for k in ("weight", "break_words", "index", "quote", "indents", "defined")}, **({"id": f.id} if "id" in f.defined else {}))
                continue
            if "id" in f.defined and f.id != mine.id:
                raise ValueError(f"field {f.name!r} has the ids {mine.id} and {f.id}")
            out._by_name[f.name] = replace(mine, **{k: getattr(f, k) for k in f.defined if k != "id"}, defined=mine.defined | f.defined)
        return out


def field_intersection(a: Iterable[int], b: Iterable[int]) -> list[int]:
    return sorted(set(a) & set(b))


def field_union(a: Iterable[int], b: Iterable[int]) -> list[int]:
    return sorted(set(a) | set(b))
