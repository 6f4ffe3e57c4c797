"""Users, per-space permissions, and the guard of each command."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN, READ, WRITE = "admin", "read", "write"
#: What each command needs; commands that are not here are not guarded.
GUARDS = (
    ("CREATE_SPACE", ADMIN), ("LIST_SPACES", ADMIN), ("PUT", WRITE), ("DELETE", WRITE), ("INSERT_VECTOR", WRITE),
    ("GET", READ), ("SEARCH_TOPK", READ), ("GET_VECTOR", READ), ("RANGE_SEARCH", READ),
)


def has_role(role: Column, permissions: Column, space: Column, wanted: Column) -> Column:
    """admin may all; write includes read."""
    own = F.try_element_at(permissions, space)
    able = F.when(wanted == READ, own.isin(READ, WRITE)).when(wanted == WRITE, own == WRITE).otherwise(F.lit(False))
    return (role == ADMIN) | F.coalesce(able, F.lit(False))


def guard(commands: DataFrame) -> DataFrame:
    """Adds allowed to (command, role, permissions, space)."""
    need = F.lit(None).cast("string")
    for command, what in GUARDS:
        need = F.when(F.upper("command") == command, what).otherwise(need)
    role = F.col("role")
    allowed = F.when(need == ADMIN, role == ADMIN).when(need.isNotNull(), has_role(role, F.col("permissions"), F.col("space"), need)).otherwise(F.lit(True))
    return commands.withColumn("allowed", allowed)


def user_format(username: Column, role: Column, permissions: Column) -> Column:
    each = F.transform(F.array_sort(F.map_entries(permissions)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    listed = F.when(F.coalesce(F.size(permissions), F.lit(0)) > 0, F.array_join(each, ", ")).otherwise(F.lit("None"))
    return F.concat(F.lit("Username: "), username, F.lit(" | Role: "), role, F.lit(" | Permissions: "), listed)


class AuthError(PermissionError):
    pass


@dataclass
class User:
    username: str
    password_hash: str
    role: str = "user"
    permissions: dict[str, str] = field(default_factory=dict)

    def may(self, space: str, wanted: str) -> bool:
        own = self.permissions.get(space)
        return self.role == ADMIN or (own in (READ, WRITE) if wanted == READ else own == WRITE if wanted == WRITE else False)


def hashed(password: str, salt: bytes | None = None) -> str:
    salt = salt or secrets.token_bytes(16)
    return f"{salt.hex()}${hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1).hex()}"


class Users:
    """All users, few and on the driver."""

    def __init__(self, rows: list[User] | None = None, admin_password: str | None = None) -> None:
        self.rows = {u.username: u for u in rows or []}
        if not self.rows and admin_password is not None:
            self.create(ADMIN, admin_password, ADMIN)

    def authenticate(self, username: str, password: str) -> User:
        user = self.get(username)
        salt = bytes.fromhex(user.password_hash.partition("$")[0])
        if not hmac.compare_digest(hashed(password, salt), user.password_hash):
            raise AuthError("invalid password")
        return user

    def get(self, username: str) -> User:
        if username not in self.rows:
            raise AuthError("user not found")
        return self.rows[username]

    def create(self, username: str, password: str, role: str = "user", permissions: dict[str, str] | None = None) -> str:
        if username in self.rows:
            raise AuthError("user already exists")
        self.rows[username] = User(username, hashed(password), role, dict(permissions or {}))
        return "USER_CREATED"

    def set_password(self, username: str, password: str) -> str:
        self.get(username).password_hash = hashed(password)
        return "USER_PASSWORD_UPDATED"

    def set_role(self, username: str, role: str) -> str:
        self.get(username).role = role
        return "USER_ROLE_UPDATED"

    def set_permissions(self, username: str, permissions: dict[str, str]) -> str:
        self.get(username).permissions = dict(permissions)
        return "USER_ROLE_UPDATED"

    def delete(self, username: str) -> str:
        self.get(username)
        del self.rows[username]
        return "USER_DELETED"

    def describe(self, username: str) -> str:
        u = self.get(username)
        listed = ", ".join(f"{k}={v}" for k, v in sorted(u.permissions.items())) or "None"
        return f"Username: {u.username} | Role: {u.role} | Permissions: {listed}"
