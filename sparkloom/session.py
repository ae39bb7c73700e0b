"""Sessions with the settings that the library expects."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ObjectStore:
    """Where an S3 store is and who asks; empty values leave what another layer or the cluster says."""

    region: str = ""
    endpoint: str = ""
    access_key: str = ""
    secret_key: str = ""
    session_token: str = ""
    path_style: bool = False
    default_chain: bool = False

    @classmethod
    def of_environment(cls, env: dict[str, str] | None = None) -> ObjectStore:
        get = (os.environ if env is None else env).get
        return cls(
            get("AWS_REGION") or get("AWS_DEFAULT_REGION", ""), get("AWS_ENDPOINT_URL", ""), get("AWS_ACCESS_KEY_ID", ""), get("AWS_SECRET_ACCESS_KEY", ""),
            get("AWS_SESSION_TOKEN", ""), get("AWS_S3_PATH_STYLE") == "true",
        )

    def over(self, base: ObjectStore) -> ObjectStore:
        """These values where they are set, those of ``base`` elsewhere."""
        return ObjectStore(*(getattr(self, f.name) or getattr(base, f.name) for f in fields(self)))

    def settings(self) -> dict[str, str]:
        """The same as settings of Spark's S3 connector."""
        if self.access_key:
            provider = "TemporaryAWSCredentialsProvider" if self.session_token else "SimpleAWSCredentialsProvider"
            found = f"org.apache.hadoop.fs.s3a.{provider}"
        else:
            found = "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider" if self.default_chain else ""
        values = {
            "endpoint.region": self.region, "endpoint": self.endpoint, "access.key": self.access_key, "secret.key": self.secret_key, "session.token": self.session_token,
            "path.style.access": "true" if self.path_style else "", "aws.credentials.provider": found,
        }
        return {f"spark.hadoop.fs.s3a.{k}": v for k, v in values.items() if v}


_everywhere = ObjectStore()


def set_object_store(store: ObjectStore) -> None:
    """Values for all sessions made from now on; they win over the environment's."""
    global _everywhere
    _everywhere = store


def session(app: str = "sparkloom", master: str | None = None, *, store: ObjectStore | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win where ``conf`` doesn't name them.

    The object store's values come from the environment, over them those of set_object_store, over them ``store``.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the frames that need them
    if master:
        builder = builder.master(master)
    layers = (store or ObjectStore()).over(_everywhere.over(ObjectStore.of_environment()))
    for key, value in layers.settings().items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
