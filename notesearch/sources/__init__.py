"""Where corpora and indexes come from and go to."""
