"""Where inbox tables come from and go to."""
