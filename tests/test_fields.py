"""Configuration of fields."""

import pytest

from lexiquarry.fields import Fields, field_intersection, field_union


def test_load():
    assert len(Fields.load({})) == len(Fields.load(None)) == len(Fields.load([])) == len(Fields.load({"fields": []})) == 0
    f = Fields.load({"fields": [{"name": "title"}, {"name": "body"}]})
    assert [f.get(0).name, f.get(1).name, f.get("body").id] == ["title", "body", 1]
    f = Fields.load([{"name": "body", "indents": {"lower": {"min": 3, "max": 9}, "upper": {"min": 5}}, "options": "word-break:false;", "weight": 2}])
    assert f.get(0).indents == ((3, 9), (5, 8)) and not f.get(0).break_words and f.get(0).weight == 2.0
    assert Fields.load([{"name": "x", "options": "word-break: true; index: true; quote: true"}]).get("x").quote == "auto"


@pytest.mark.parametrize("config", [
    {"fields": "text"}, {"fields": ["key", 5]}, [{}, {}], [{"name": "b", "indents": 5}], [{"name": "b", "indents": {"lower": 5}}], [{"name": "b", "indents": {"medium": {}}}],
    [{"name": "b", "indents": {"lower": {"all": 5}}}], [{"name": "b", "options": 5}], [{"name": "b", "options": "my-code: true"}], [{"name": "b", "options": "quote"}], [{"name": "b"}, {"name": "b"}],
    [{"name": "a", "id": 1}, {"name": "b", "id": 1}], [{"name": "a", "id": -1}], [{"name": "a", "weight": "x"}], [{"name": "a", "more": 1}],
])
def test_invalid(config):
    with pytest.raises(ValueError):
        Fields.load(config)


def test_save_and_join():
    config = [{"name": "a", "options": "word-break: off; quote: always", "weight": 3.0}, {"name": "b", "indents": {"lower": {"max": 4}}}]
    f = Fields.load(config)
    assert [*Fields.load(f.save())] == [*f]
    g = f.join(Fields.load([{"name": "a", "options": "index: off"}, {"name": "c"}]))
    assert (g.get("a").index, g.get("a").quote, g.get("a").break_words, g.get("c").id) == (False, "always", False, 2)
    with pytest.raises(ValueError):
        f.join(Fields.load([{"name": "a", "id": 7}]))
    assert f.options_of("zzz").indents == ((2, 8), (4, 8)) and f.add("a") is f.get("a") and f.add("new").id == 2
    assert field_intersection([1, 2, 3], [2, 3, 9]) == [2, 3] and field_union([3, 1], [2, 3]) == [1, 2, 3]
