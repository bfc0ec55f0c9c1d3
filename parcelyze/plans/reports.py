"""Usage reports, catalogue filters, pages and feeds, as DataFrame operations on activity, file and article tables.

Activity: (id, user_id, company_id, size_in_bytes, identified_issues, healed_issues, heal_status, created_at,
deleted_at). Files and articles likewise carry the columns that the functions name. Times are UTC.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_keyword, normalize_phone

# Plans and statuses.
PLANS = ("free", "pro", "advanced")
STATUSES = ("dry-run-complete", "queued", "processing", "completed", "failed", "cancelled")
FILE_TYPES = ("geojson", "json", "kml", "kmz", "shp", "zip", "dwg", "dgn", "dxf")
REPAIR_COUNTERS = (
    "duplicateVerticesRemoved", "invalidRingsRepaired", "ringsAutoClosed", "holesRemoved", "spikesRemoved", "selfIntersectionsRepaired", "undershootsRepaired",
    "overshootsRepaired", "gapsClosed", "neighborVerticesInserted", "overlapsHealed", "exactDuplicates", "sliversRemovedCount",
)
SEATS = 3
TOTALS = ("bytes", "identified_issues", "healed_issues")


# ---- parameters -----------------------------------------------------------------------------------------------


def report_range(start: str | None, end: str | None, today: date) -> tuple[date, date]:
    """(first day, day after the last): strict ISO days, 1 to 366 of them; the last 30 days by default."""
    if (start is None) != (end is None):
        raise ValueError("give both days or none")
    if start is None:
        return today - timedelta(days=29), today + timedelta(days=1)
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if a.isoformat() != start or b.isoformat() != end or not 1 <= (b - a).days + 1 <= 366:
        raise ValueError("invalid range of days")
    return a, b + timedelta(days=1)


def page_parameters(skip: int = 0, limit: int = 10, most: int = 50) -> tuple[int, int]:
    if not (isinstance(skip, int) and isinstance(limit, int) and skip >= 0 and 1 <= limit <= most):
        raise ValueError("invalid page")
    return skip, limit


def file_filters(search: str = "", file_type: str | None = None, has_issues: bool | None = None, start: str | None = None, end: str | None = None) -> Column:
    """A condition on (name, original_name, identified_issues, created_at); wildcard characters are literal."""
    if len(search.strip()) > 150 or file_type is not None and file_type not in FILE_TYPES or start and end and start >= end:
        raise ValueError("invalid file filter")
    out = F.lit(True)
    if text := search.strip().lower():
        out &= F.lower("name").contains(text) | F.lower("original_name").contains(text)
    if file_type:
        out &= F.lower("original_name").endswith(f".{file_type}")
    if has_issues is not None:
        out &= (F.col("identified_issues") > 0) if has_issues else (F.col("identified_issues") == 0)
    if start:
        out &= F.col("created_at") >= F.lit(start).cast("timestamp")
    if end:
        out &= F.col("created_at") < F.lit(end).cast("timestamp")
    return out


def user_filters(search: str = "", plan: str | None = None, role: str | None = None) -> Column:
    """A condition on (name, phone, plan_code, roles)."""
    out = F.lit(True)
    if search:
        out &= F.lower("name").contains(search.lower()) | F.col("phone").contains(normalize_phone(F.lit(search)))
    if plan:
        out &= F.col("plan_code") == plan
    if role:
        out &= F.array_contains("roles", role)
    return out


def article_filters(search: str = "", category: str = "", keyword: str = "") -> Column:
    """A condition on (title, excerpt, category, keywords)."""
    if len(search) > 100 or len(category) > 80 or len(keyword) > 48:
        raise ValueError("invalid article filter")
    out = F.lit(True)
    if category:
        out &= F.lower("category") == category.lower()
    if keyword:
        out &= F.array_contains("keywords", normalize_keyword(F.lit(keyword)))
    if search:
        word = normalize_keyword(F.lit(search))
        out &= F.lower("title").contains(search.lower()) | F.lower("excerpt").contains(search.lower()) | F.array_contains("keywords", word)
    return out


# ---- activity -------------------------------------------------------------------------------------------------


def _instant(table: DataFrame, at: str, day: date) -> Column:
    """The instant at which a UTC day begins, in the type of a column (one without a zone is in UTC)."""
    return F.lit(str(day)).cast("timestamp_ntz") if dict(table.dtypes)[at] == "timestamp_ntz" else F.lit(f"{day} 00:00:00Z").cast("timestamp")


def utc_day(table: DataFrame, at: str) -> Column:
    """The UTC day of an instant as text, whatever the session's time zone."""
    wall = F.col(at) if dict(table.dtypes)[at] == "timestamp_ntz" else F.convert_timezone(None, F.lit("UTC"), F.col(at).cast("timestamp_ntz"))
    return wall.cast("date").cast("string")


def within(table: DataFrame, start: date, end: date, at: str = "created_at") -> DataFrame:
    return table.where((F.col(at) >= _instant(table, at, start)) & (F.col(at) < _instant(table, at, end)))


def _sums() -> list[Column]:
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return [total("size_in_bytes", "bytes"), total("identified_issues", "identified_issues"), total("healed_issues", "healed_issues")]


def daily(activity: DataFrame) -> DataFrame:
    """One row a day that has uploads."""
    return activity.groupBy(utc_day(activity, "created_at").alias("date")).agg(F.count("*").alias("uploads"), F.count_if(F.col("heal_status") == "completed").alias("completed"), F.count_if(F.col("heal_status") == "failed").alias("failed"), *_sums())


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    days = F.sequence(F.lit(start), F.lit(end - timedelta(days=1)))
    return spark.range(1).select(F.explode(days).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("date"))


def zero_filled(days: DataFrame, report: DataFrame) -> DataFrame:
    """Every day, with 0 where the report has no row."""
    return days.join(report, "date", "left").na.fill(0, ["uploads", "completed", "failed", *TOTALS])


def status_counts(activity: DataFrame) -> DataFrame:
    return activity.groupBy(F.col("heal_status").alias("status")).agg(F.count("*").alias("count"))


def usage(activity: DataFrame, *keys: str) -> DataFrame:
    """Uploads and sums, over all or by keys."""
    return activity.groupBy(*keys).agg(F.count("*").alias("uploads"), *_sums())


def summary(activity: DataFrame) -> DataFrame:
    """The one-row summary; ``processing`` counts queued jobs too."""
    status = lambda *s: F.count_if(F.col("heal_status").isin(*s))
    return activity.agg(F.count("*").alias("uploads"), *_sums(), status("completed").alias("completed"), status("failed").alias("failed"), status("processing", "queued").alias("processing"), F.count("deleted_at").alias("deleted_files"))


def plan_distribution(spark: SparkSession, users: DataFrame, plans: Sequence[str] = PLANS) -> DataFrame:
    """Users of each known plan, 0 included."""
    known = spark.createDataFrame([(p,) for p in plans], "code string")
    counts = users.groupBy(F.col("plan_code").alias("code")).agg(F.count("*").alias("count"))
    return known.join(counts, "code", "left").na.fill(0, ["count"])


def with_usage(users: DataFrame, activity: DataFrame, files: DataFrame, user: str = "user_id") -> DataFrame:
    """Users with their usage and stored files, 0 where they have none."""
    used = usage(activity, user)
    stored = files.groupBy(user).agg(F.count("*").alias("stored_files"))
    return users.join(used, user, "left").join(stored, user, "left").na.fill(0, ["uploads", "stored_files", *TOTALS])


def active_companies(companies: DataFrame, users: DataFrame, plan: str = "advanced") -> DataFrame:
    """Companies whose owner has the plan."""
    return companies.join(users.where(F.col("plan_code") == plan).select(F.col("user_id").alias("owner_id")), "owner_id", "left_semi")


def live_invitations(invitations: DataFrame, now: Column) -> DataFrame:
    return invitations.where((F.col("status") == "pending") & (F.col("expires_at") > now))


def seats(members: DataFrame, invitations: DataFrame, now: Column) -> DataFrame:
    """(company_id, members, invitations, limit): reserved seats."""
    one = lambda t, a, b: t.groupBy("company_id").agg(F.sum(a).alias("members"), F.sum(b).alias("invitations"))
    both = members.select("company_id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(live_invitations(invitations, now).select("company_id", F.lit(0), F.lit(1)))
    return one(both, "a", "b").withColumn("limit", F.lit(SEATS))


def visible_images(images: DataFrame, companies: DataFrame, members: DataFrame, user: str, now: Column) -> DataFrame:
    """Images in use of companies that the user owns or belongs to: two equi-joins instead of a join with OR."""
    owned = companies.where(F.col("owner_id") == user).select("company_id")
    joined = members.where(F.col("user_id") == user).select("company_id")
    live = images.where((F.col("status") != "uploading") | (F.col("expires_at") > now))
    return live.join(owned.union(joined).distinct(), "company_id", "left_semi")


def attributed_company(users: DataFrame, companies: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, company_id): the company that an upload counts for: the owned one, else the member's, if its owner's plan is advanced."""
    paid = active_companies(companies, users)
    own = paid.select(F.col("owner_id").alias("user_id"), F.col("company_id").alias("owned"))
    other = members.join(paid.select("company_id"), "company_id").select("user_id", F.col("company_id").alias("joined"))
    return users.select("user_id").join(own, "user_id", "left").join(other, "user_id", "left").select("user_id", F.coalesce("owned", "joined").alias("company_id"))


def repairs_applied(results: DataFrame) -> DataFrame:
    """Adds ``repairs_applied``: the sum of the known counters that the table has."""
    have = [F.coalesce(F.col(c), F.lit(0)) for c in REPAIR_COUNTERS if c in results.columns]
    return results.withColumn("repairs_applied", sum(have, F.lit(0)).cast("long"))


# ---- pages and feeds --------------------------------------------------------------------------------------------


def page(table: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    """Rows skip + 1 to skip + limit in order."""
    skip, limit = page_parameters(skip, limit)
    return table.orderBy(*order).offset(skip).limit(limit)


def page_with_total(table: DataFrame, order: Sequence[Column], skip: int, limit: int) -> DataFrame:
    """A page with ``total``, the rows of the whole table, on each of its rows."""
    total = F.broadcast(table.agg(F.count("*").alias("total")))  # one row
    return page(table, order, skip, limit).crossJoin(total)


def file_summaries(files: DataFrame, analyses: DataFrame, user: Column) -> DataFrame:
    """A user's files with the state of their analysis: 'unavailable' and null where there is none or it is another user's.

    files: (file_id, owner_id, name, original_name, size_in_bytes, created_at, updated_at); analyses: (file_id, owner_id,
    heal_status, issues_found).
    """
    own = analyses.where(F.col("owner_id") == user).select("file_id", "heal_status", "issues_found")
    f = files.where(F.col("owner_id") == user).join(own, "file_id", "left")
    return f.select("file_id", "name", "original_name", "size_in_bytes", "created_at", "updated_at", F.coalesce("heal_status", F.lit("unavailable")).alias("status"), F.coalesce(F.col("heal_status") == "completed", F.lit(False)).alias("is_healed"), "issues_found")


def admin_counts(users: DataFrame, companies: DataFrame, activity: DataFrame, files: DataFrame, start: date, end: date) -> DataFrame:
    """One row: users, new_users, companies, active_companies, stored_files, deleted_files."""
    new = users.agg(F.count("*").alias("users"), F.count_if((F.col("created_at") >= _instant(users, "created_at", start)) & (F.col("created_at") < _instant(users, "created_at", end))).alias("new_users"))
    counted = lambda t, name: t.agg(F.count("*").alias(name))
    out = new.crossJoin(counted(companies, "companies")).crossJoin(counted(active_companies(companies, users), "active_companies"))
    return out.crossJoin(counted(files, "stored_files")).crossJoin(counted(activity.where("deleted_at is not null"), "deleted_files"))  # one row each


def live(table: DataFrame, at: str, now: Column, keep: str) -> DataFrame:
    """What retention leaves: rows of at most ``keep`` (an interval, such as 7 days) before now; later ones expire."""
    return table.where(F.col(at) >= now - F.expr(f"interval {keep}"))


def keyset_page(table: DataFrame, at: str, identity: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next ``limit`` + 1 rows, newest first, after a cursor (time, id); the extra row tells that there are more."""
    if cursor is not None:
        t, i = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        table = table.where((F.col(at) < t) | ((F.col(at) == t) & (F.col(identity) < i)))
    return table.where(F.col(at).isNotNull()).orderBy(F.col(at).desc(), F.col(identity).desc()).limit(limit + 1)


def facet(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))


def latest(table: DataFrame, at: str, identity: str, n: int = 10) -> DataFrame:
    return table.orderBy(F.col(at).desc(), F.col(identity).asc()).limit(n)


def issue_page(issues: DataFrame, code: str | None, skip: int, limit: int) -> DataFrame:
    """Issues of a code in order of their index, which they keep."""
    skip, limit = page_parameters(skip, limit, 100)
    some = issues if code is None else issues.where(F.col("code") == code)
    return some.orderBy("issue_index").offset(skip).limit(limit)
