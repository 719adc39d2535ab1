"""Names with a special meaning in source text and in the package index."""

# pragmas, never counted as packages
PRAGMAS = """
strict warnings utf8 feature vars lib base parent constant autodie experimental bigint bignum bigrat integer bytes
charnames diagnostics encoding fields filetest if less locale open ops overload re sigtrap sort subs threads version
""".split()

# packages that belong to the interpreter
CORE_PACKAGES = """
strict warnings Carp File::Spec Data::Dumper Getopt::Long Pod::Usage Scalar::Util List::Util Time::Local File::Basename
File::Path IO::File IO::Handle Exporter Test::More Test::Simple Digest::MD5 MIME::Base64 Storable Socket Fcntl POSIX
Errno constant vars base parent lib utf8 feature Config DynaLoader XSLoader AutoLoader SelfLoader Benchmark File::Find
File::Copy File::Temp File::Glob Cwd FindBin Term::ReadLine B O re overload attributes fields bytes charnames integer
less locale open ops sigtrap sort subs threads threads::shared version vmsish
""".split()

# packages dropped from detected dependencies
DETECTION_CORE = """
Carp Data::Dumper File::Basename File::Path File::Spec FindBin Getopt::Long IO::File IO::Handle List::Util
Scalar::Util Time::Local Time::Piece POSIX Storable Socket Fcntl
""".split()

# first words that mark a hyphenated name as a distribution
DISTRIBUTION_PREFIXES = "Perl App Test Data File JSON XML Web HTTP Net DBI DBD".split()
