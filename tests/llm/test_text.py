import weakref

from offerlens.llm import text


def test_a_worker_keeps_one_model():
    made = []

    def make(name):
        return lambda: made.append(name) or [name]

    first = text.kept_model("a", make("a"))
    assert text.kept_model("a", make("a")) is first and made == ["a"]
    assert text.kept_model("b", make("b")) == ["b"] and list(text._model) == ["b"]
    text.drop_model()
    assert not text._model
    text.drop_model()
    assert text.kept_model("a", make("a")) is not first and made == ["a", "b", "a"]


def test_a_first_model_too_gives_back_what_earlier_operators_left(monkeypatch):
    given = []
    monkeypatch.setattr(text, "_model", {})
    monkeypatch.setattr(text, "_give_back", lambda: given.append(len(text._model)))
    assert [text.kept_model(key, lambda: key.upper()) for key in ("a", "a", "b")] == ["A", "A", "B"]
    assert given == [0, 0] and text._model == {"b": "B"}


def test_a_task_without_a_model_frees_its_batches_before_it_ends(monkeypatch):
    class Batch:
        pass

    alive, trimmed = [], []
    monkeypatch.setattr(text, "_model", {"a": "A"})
    monkeypatch.setattr(text, "_trim", lambda: trimmed.append((len(text._model), sum(ref() is not None for ref in alive))))

    @text.leaves_nothing
    def task(batches):
        for number in batches:
            held = Batch()
            alive.append(weakref.ref(held))
            yield number

    assert list(task(iter(range(3)))) == [0, 1, 2] and task.__name__ == "task"
    assert len(alive) == 3 and trimmed[-1] == (0, 0)
