"""A Python data source over a git repository's objects: every distinct blob once, in partitions."""

from __future__ import annotations

import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a blob that is read; objects of a partition.
MAX_BLOB, PER_PARTITION = 8 << 20, 500


class _Chunk(InputPartition):
    def __init__(self, objects):
        self.objects = objects


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.most = options["path"], int(options.get("maxBlobs", 0))

    def _git(self, *args, **more):
        return subprocess.run(["git", "-C", self.repo, *args], capture_output=True, check=True, **more).stdout

    def partitions(self):
        """Object ids are listed on the driver: all, or as many as the option maxBlobs says, where it is given. Contents are read by the tasks."""
        seen, rows = set(), []
        for line in self._git("rev-list", "--objects", "--all").decode("utf-8", "replace").splitlines():
            sha, _, path = line.partition(" ")
            if path and sha not in seen and (not self.most or len(rows) < self.most):
                seen.add(sha)
                rows.append((sha, path))
        return [_Chunk(rows[i : i + PER_PARTITION]) for i in range(0, len(rows), PER_PARTITION)] or [_Chunk([])]

    def read(self, partition):
        """One object after the other through a pipe: a blob is all that is in memory."""
        if not partition.objects:
            return
        with subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for sha, path in partition.objects:
                git.stdin.write(f"{sha}\n".encode())
                git.stdin.flush()
                parts = git.stdout.readline().split()
                if len(parts) < 3:  # missing
                    continue
                left = size = int(parts[2])
                wanted = parts[1] == b"blob" and size <= MAX_BLOB
                body = git.stdout.read(size) if wanted else b""
                left -= len(body)
                while left > 0:
                    left -= len(git.stdout.read(min(left, 1 << 20)))
                git.stdout.read(1)
                if wanted and b"\0" not in body[:8000]:
                    yield sha, path, body.decode("utf-8", "replace")
            git.stdin.close()


class GitBlobs(DataSource):
    """spark.dataSource.register(GitBlobs); spark.read.format("git_blobs").load(folder): sha, file, content."""

    @classmethod
    def name(cls):
        return "git_blobs"

    def schema(self):
        return "sha string, file string, content string"

    def reader(self, schema):
        return _Reader(self.options)
