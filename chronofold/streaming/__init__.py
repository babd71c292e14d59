"""Extensions for streams; nothing here is needed for a batch run."""
