"""A PySpark-native engine that prepares text corpora."""

__all__ = ["CleaningEventV1", "FileManifestEntryV1", "Profile", "QuarantineRecordV1", "RecordV1", "SamplePlanV1", "ValidationError", "profile_jsonl", "profile_records", "validate_jsonl"]


def __getattr__(name: str):
    """The public names, imported when they are asked for: workers that need one module import no more."""
    if name in __all__:
        from . import api

        return getattr(api, name)
    raise AttributeError(name)
