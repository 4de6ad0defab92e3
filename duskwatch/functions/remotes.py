"""Git remotes, read from the text of a ``.git/config``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a remote's address, host, owner and repository stand.
REMOTE_URL = r"(?m)^\s*url\s*=\s*(.+?)\s*$"
SCP_HOST = r"^[^@\s]+@([^:/\s]+)[:/]"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#\s]+)"
OWNER_REPO = r"[:/]([^:/\s]+)/([^/\s]+?)(?:\.git)?/?\z"


def remote_urls(config: Column) -> Column:
    return F.regexp_extract_all(config, F.lit(REMOTE_URL), F.lit(1))


def host_of(url: Column) -> Column:
    scp = F.nullif(F.regexp_extract(url, SCP_HOST, 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(url, URL_HOST, 1), F.lit(""))
    return F.lower(F.coalesce(scp, plain))


def remote_hosts(config: Column) -> Column:
    hosts = F.transform(remote_urls(config), lambda url: host_of(url))
    return F.filter(hosts, lambda host: host.isNotNull())


def github_remote(config: Column) -> Column:
    """``struct<owner, repo>`` of the first GitHub remote that names both, else null."""

    def usable(url: Column) -> Column:
        return F.contains(F.coalesce(host_of(url), F.lit("")), F.lit("github")) & url.rlike(
            OWNER_REPO
        )

    url = F.get(F.filter(remote_urls(config), usable), F.lit(0))
    return F.when(
        url.isNotNull(),
        F.struct(
            F.regexp_extract(url, OWNER_REPO, 1).alias("owner"),
            F.regexp_extract(url, OWNER_REPO, 2).alias("repo"),
        ),
    )
