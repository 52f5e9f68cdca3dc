"""An adaptive radix tree over byte keys: node layouts that grow from 4 to 16,
48 and 256 children, and compressed paths. A key may be the beginning of another."""

from __future__ import annotations

from bisect import bisect_left


class Few:
    """Up to 4, then up to 16 children: their bytes in order beside them."""

    __slots__ = ("bytes", "kids", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.kids, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid) -> Few | Indexed:
        """Adds or replaces a child; the layout that now holds the children."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.room:
            if self.room == 4:
                self.room = 16
            else:
                return Indexed(self.items()).put(byte, kid)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self):
        return zip(self.bytes, self.kids)


class Indexed:
    """Up to 48 children, found by a table of 256 places."""

    __slots__ = ("place", "kids")

    def __init__(self, items):
        self.place, self.kids = bytearray(256), []
        for byte, kid in items:
            self.put(byte, kid)

    def get(self, byte: int):
        at = self.place[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid) -> Indexed | Whole:
        at = self.place[byte]
        if at:
            self.kids[at - 1] = kid
        elif len(self.kids) == 48:
            return Whole(self.items()).put(byte, kid)
        else:
            self.kids.append(kid)
            self.place[byte] = len(self.kids)
        return self

    def items(self):
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.place) if at)


class Whole:
    """A child for each byte."""

    __slots__ = ("kids",)

    def __init__(self, items):
        self.kids = [None] * 256
        for byte, kid in items:
            self.kids[byte] = kid

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> Whole:
        self.kids[byte] = kid
        return self

    def items(self):
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


class Node:
    """``path``: the bytes that lead here from the node above (its branching byte
    first); ``key``: one whole key that passes; ``values`` of the key that ends here."""

    __slots__ = ("path", "kids", "values", "key")

    def __init__(self, path: bytes, key):
        self.path, self.key, self.kids, self.values = path, key, Few(), []


class Tree:
    def __init__(self):
        self.root = Node(b"", None)

    def add(self, key: bytes, value, note) -> None:
        """``note`` is kept as ``key`` by the nodes that this key makes."""
        node, at = self.root, 0
        if node.key is None:
            node.key = note
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = Node(key[at:], note)
                node.kids = node.kids.put(key[at], kid)
                node = kid
                break
            path, same = kid.path, 1
            if key.startswith(path, at):
                same = len(path)
            else:
                most = min(len(path), len(key) - at)
                while same < most and path[same] == key[at + same]:
                    same += 1
                above = Node(path[:same], kid.key)
                kid.path = path[same:]
                above.kids = above.kids.put(kid.path[0], kid)
                node.kids = node.kids.put(path[0], above)
                kid = above
            node, at = kid, at + same
        node.values.append(value)

    def way(self, key: bytes) -> set[int]:
        """``id`` of the nodes that a key of the tree passes, its end included."""
        node, at, out = self.root, 0, {id(self.root)}
        while at < len(key):
            node = node.kids.get(key[at])
            at += len(node.path)
            out.add(id(node))
        return out

    def upwards(self):
        """(node, number of key bytes above its path) of every node, children before their parent."""
        todo, out = [(self.root, 0)], []
        while todo:
            node, at = todo.pop()
            out.append((node, at))
            todo += [(kid, at + len(node.path)) for _, kid in node.kids.items()]
        return reversed(out)
