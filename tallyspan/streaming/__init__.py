"""The journal of a running job: strict sequences, open invocations and deadlines, in batch and as a stream."""
