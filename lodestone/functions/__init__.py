"""Functions of single texts that built-in ones can't express; queries run them in Arrow batches."""
