"""Streaming: the batch scoring and tiering applied to accounts as they arrive.

The source has no streaming part; its pre-approval step scores the pool of
accounts without a loan in one batch.  ``score_stream`` applies exactly the
same operators (feature assembly, bagged model scores, average, tiers
against a fixed cut taken from the batch pool) to a Structured Streaming
source, so new accounts can be tiered incrementally.  It is stateless
(a narrow map per micro-batch), so no watermark or state store is needed.
"""
