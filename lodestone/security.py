"""Who may do what: grants, column grants, row policies, tenants.

Row filters are laid beneath everything else a query does, as plain filters,
so that they narrow scans; scalar expressions never throw, so that a hidden
row cannot be told by an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .errors import ColumnsWithheld, Forbidden, TenantRequired
from .functions.language import as_predicate
from .functions.predicates import FALSE, TRUE, And, Compare, IsNull, Or, Predicate
from .schema import TableDef

READ, INSERT, UPDATE, DELETE, EXPLAIN, READ_DELETED = ACTIONS = ("read", "insert", "update", "delete", "explain", "read_deleted")


@dataclass(frozen=True)
class Context:
    principal: Any = None
    roles: tuple[str, ...] = ()
    tenant: Any = None
    superuser: bool = False


ROOT = Context(superuser=True)


@dataclass
class Policy:
    """Rows that some roles may touch by some actions. ``rows`` maps a context
    to a predicate, or is a predicate's text, in which ``:principal`` and
    ``:tenant`` stand for the caller's; those of all policies that apply are
    joined by OR."""

    table: str
    rows: Callable[[Context], Predicate] | str
    actions: tuple[str, ...] = ACTIONS
    roles: tuple[str, ...] | None = None  # None: all


    def bound(self, ctx: Context) -> Predicate:
        return as_predicate(self.rows, ctx) if isinstance(self.rows, str) else self.rows(ctx)


@dataclass
class Security:
    grants: set[tuple[str, str, str]] = field(default_factory=set)  # role, table, action
    columns: dict[tuple[str, str], set[str]] = field(default_factory=dict)  # (role, table)
    policies: list[Policy] = field(default_factory=list)

    def grant(self, role: str, table: str, *actions: str) -> Security:
        self.grants |= {(role, table, a) for a in actions or ACTIONS}
        return self

    def grant_columns(self, role: str, table: TableDef, *names: str) -> Security:
        missing = [k for k in table.primary_key if k not in names]
        if missing:
            raise Forbidden(f"a column grant on {table.name} must hold its key: {', '.join(missing)}")
        self.columns.setdefault((role, table.name), set()).update(names)
        return self

    def policy(self, *policies: Policy) -> Security:
        self.policies += policies
        return self

    def authorize(self, ctx: Context, table: str, action: str) -> None:
        if not ctx.superuser and not any((r, table, action) in self.grants for r in ctx.roles):
            raise Forbidden(f"no role of the caller may {action} {table}")

    def readable(self, ctx: Context, table: TableDef) -> list[str]:
        """Columns that the caller may read: the union over its roles; a role
        that reads the table and has no column grant reads all."""
        names = [c.name for c in table.live]
        if ctx.superuser:
            return names
        seen: set[str] = set()
        for r in ctx.roles:
            if (r, table.name, READ) in self.grants:
                seen |= self.columns.get((r, table.name), set(names))
        return [n for n in names if n in seen]

    def withhold(self, ctx: Context, table: TableDef, refs: set[str]) -> None:
        hidden = sorted(refs & {c.name for c in table.live} - set(self.readable(ctx, table)))
        if hidden:
            raise ColumnsWithheld(f"the caller may not read {', '.join(hidden)} of {table.name}")

    def row_filter(self, ctx: Context, table: TableDef, action: str = READ, deleted: bool = False) -> Predicate:
        parts: list[Predicate] = []
        if table.tenant and not ctx.superuser:
            if ctx.tenant is None:
                raise TenantRequired(f"{table.name} is kept by tenant and the caller has none")
            parts.append(Compare(table.tenant, "=", ctx.tenant))
        if table.soft_delete:
            if deleted:
                self.authorize(ctx, table.name, READ_DELETED)
            else:
                parts.append(IsNull(table.soft_delete))
        own = [p for p in self.policies if p.table == table.name]
        if own and not ctx.superuser:
            fit = [p.bound(ctx) for p in own if action in p.actions and (p.roles is None or set(p.roles) & set(ctx.roles))]
            parts.append(Or(tuple(fit)) if fit else FALSE)
        return And(tuple(parts)) if parts else TRUE
