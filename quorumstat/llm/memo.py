"""A bounded memory of what has been worked out for words, in two generations."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable


class Memo:
    """``get(keys)`` gives the value of each key; only keys that are not remembered are learnt.

    When ``most`` keys are held they become the old generation, from which keys that come
    up again are taken over; what lies unused for a whole generation is forgotten.
    """

    def __init__(self, learn: Callable[[list], Iterable], most: int):
        self.learn, self.most = learn, most
        self.new: dict[Hashable, object] = {}
        self.old: dict[Hashable, object] = {}

    def get(self, keys: list) -> map:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        todo = []
        for k in set(keys).difference(self.new):
            v = self.old.get(k)
            if v is None:
                todo.append(k)
            else:
                self.new[k] = v
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            self.new.update(zip(part, self.learn(part), strict=True))
        return map(self.new.__getitem__, keys)
