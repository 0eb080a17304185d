"""What can go wrong with files and settings."""


class LoaderError(Exception):
    """A file is not of the kind that a loader reads."""


class WriterError(Exception):
    """No writer takes this kind of file, or it can't be written."""


class ConfigError(Exception):
    """Settings that are unknown, missing or of a wrong kind."""
