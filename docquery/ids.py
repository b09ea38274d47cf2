"""Identifier strategies of collections."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from enum import Enum


class IdType(Enum):
    UUID = "Uuid"
    INT = "Int"
    NONE = "None"


@dataclass(frozen=True)
class DbConfig:
    """How a collection gets its ids, and under which key."""

    id_type: IdType = IdType.UUID
    id_key: str = "id"

    @classmethod
    def int(cls, id_key: str = "id") -> DbConfig:
        return cls(IdType.INT, id_key)

    @classmethod
    def uuid(cls, id_key: str = "id") -> DbConfig:
        return cls(IdType.UUID, id_key)

    @classmethod
    def none(cls, id_key: str = "id") -> DbConfig:
        return cls(IdType.NONE, id_key)


class IdManager:
    """Generates ids; the integer sequence never moves backwards."""

    def __init__(self, id_type: IdType) -> None:
        self.id_type = id_type
        self.current = 0

    def next(self) -> int | str | None:
        if self.id_type is IdType.INT:
            self.current = (self.current + 1) % (1 << 64)
            return self.current
        return str(uuid.uuid4()) if self.id_type is IdType.UUID else None

    def seen(self, value: object) -> None:
        if self.id_type is IdType.INT and isinstance(value, int) and not isinstance(value, bool):
            self.current = max(self.current, value)
