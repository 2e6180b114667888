"""Relational operators over chunks (file_path, chunk_no, content, ...), each for a whole batch of queries."""
