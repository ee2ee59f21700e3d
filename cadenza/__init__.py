"""Score analytics, playback, job-queue and account data as Spark DataFrame operators."""
