"""The maintenance of all tenants: sweep, compaction, pruning and backup by a policy table, failures kept apart."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from recollect.jobs.engine import Engine
from recollect.sources import backup, config

REPORT = "tenant string, job string, status string, detail string"
FORMAT = "%Y-%m-%d %H:%M:%S"


def rotate(spark: SparkSession, root: str, policy: DataFrame, now: str, backups: str | None = None, keys: Callable[[str], bytes] | None = None, every_hours: int = 24, at_once: int = 4, default_days: int = 30) -> DataFrame:
    """Run the jobs of every tenant of policy (tenant, days) and report tenant, job, status (ok, failed or not_due) and detail, by tenant.

    sweep drops chunks older than days (0: off, null: as the tenant's settings say, or default_days) and compacts only if any were. maintenance prunes old versions,
    once in every_hours by a time kept beside the store. backup writes to backups/<tenant>/<now>, if backups is given, under
    the key that keys gives for the tenant. A job that fails is named with its reason; the tenant's other jobs and the
    other tenants go on. Each job is a Spark job over the tenant's tables; at_once tenants run side by side. The driver
    holds the policy's rows only.
    """
    tenants = [(r["tenant"], None if r["days"] is None else int(r["days"])) for r in policy.select("tenant", "days").distinct().orderBy("tenant").collect()]

    def jobs(tenant: str, days: int | None) -> list[tuple[str, str, str, str]]:
        engine = Engine(spark, root, tenant)
        state = f"{engine.store.home}/maintenance.json"

        def sweep() -> tuple[str, str]:
            return "ok", f"expired {engine.sweep(now, config.read(engine.store, default_days).days if days is None else days)}"

        def maintain() -> tuple[str, str]:
            last = (engine.store.read_json(state) or {}).get("pruned_at")
            due = datetime.strptime(last, FORMAT) + timedelta(hours=every_hours) if last else None
            if due and datetime.strptime(now, FORMAT) < due:
                return "not_due", f"next at {due.strftime(FORMAT)}"
            freed = engine.prune() if engine.store.versions() else 0
            engine.store.delete(state)
            engine.store.write_json(state, {"pruned_at": now})
            return "ok", f"freed {freed} bytes"

        def save() -> tuple[str, str]:
            rows = backup.backup(engine.store, f"{backups}/{tenant}/{now.replace(' ', 'T').replace(':', '')}", keys(tenant), now)
            return "ok", f"chunks {rows['chunks']}"

        out = []
        for name, job in (("sweep", sweep), ("maintenance", maintain), *((("backup", save),) if backups else ())):
            try:
                out.append((tenant, name, *job()))
            except Exception as e:  # whatever one job meets must not stop the others
                out.append((tenant, name, "failed", f"{type(e).__name__}: {str(e)[:300]}"))
        return out

    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for found in pool.map(lambda t: jobs(*t), tenants) for r in found]
    return spark.createDataFrame(rows, REPORT)


def failed(report: DataFrame) -> list[str]:
    """tenant/job of the failures, for a run that must end loudly."""
    return [f"{r['tenant']}/{r['job']}" for r in report.filter("status = 'failed'").orderBy("tenant", "job").collect()]
