"""Closed vocabularies of the graph. Results depend on these words being exactly so."""

from __future__ import annotations

NODE_KINDS = "file package class function method field constant route".split()
EDGE_KINDS = "contains calls references imports extends implements overrides sink".split()

#: Authority of an edge's provenance; null ranks as static, an unknown one as 0.
PROVENANCE_RANK = {"llm": -3, "heuristic": -2, "inferred": -1, "static": 0, "framework": 1, "symtab": 2, "xs": 2, "optree": 3, "mop": 3}

# Fixed values.
BUILTINS = frozenset("""
    print printf say sprintf warn die defined ref bless wantarray
    push pop shift unshift splice map grep sort reverse join split
    keys values each exists delete scalar length substr index rindex
    open close read write chomp chop chr ord lc uc lcfirst ucfirst
    eval do require return last next redo local my our
    abs int sqrt rand srand sleep time
    binmode fileno eof seek tell sysread syswrite sysseek getc select
    opendir readdir closedir rewinddir mkdir rmdir unlink rename
    symlink link readlink stat lstat chmod chown utime glob fcntl flock truncate
    fork wait waitpid exec system kill exit alarm getppid umask chdir chroot times
    pack unpack vec sin cos atan2 exp log hex oct quotemeta pos crypt fc
    socket socketpair bind connect listen accept shutdown send recv
    getsockname getpeername getsockopt setsockopt
    caller localtime gmtime tie untie tied goto prototype lock undef
""".split())

# Fixed values.
SINK_COMMANDS = frozenset("system exec syscall".split())
SINK_SQL = frozenset("do execute selectall_arrayref selectall_hashref selectrow_array selectrow_arrayref selectrow_hashref selectcol_arrayref".split())
UNIVERSAL = frozenset("can isa DOES VERSION".split())

# Fixed values.
EXTERNAL = frozenset("""
    ok is isnt like unlike cmp_ok is_deeply pass fail diag note plan done_testing
    subtest skip todo todo_skip BAIL_OUT use_ok require_ok can_ok isa_ok new_ok ref_ok
    exception dies_ok lives_ok throws_ok lives_and warning warnings_are
    cmp_deeply cmp_bag bag set superhashof
    croak confess carp cluck
    first sum sum0 max min maxstr minstr reduce reductions any all none notall
    uniq uniqint uniqnum uniqstr pairs pairmap pairgrep pairkeys pairvalues
    shuffle product head tail
    blessed reftype weaken unweaken isweak looks_like_number dualvar readonly openhandle
    encode_json decode_json to_json from_json
    D U T F E DF DNE hash array item field end etc in_set not_in_set match mismatch
    validator object meta check_isa number string bool exact_ref within seq subset mock
    is_plain_arrayref is_plain_hashref is_arrayref is_hashref is_coderef is_ref is_blessed_ref
    is_plain_coderef is_regexpref is_scalarref is_globref is_plain_scalarref is_refref
    strftime floor ceil fmod pow tv_interval gettimeofday usleep nanosleep encode_utf8 decode_utf8
""".split())
EXTERNAL_PREFIXES = """
    AE AnyEvent EV Coro POSIX Carp Scalar::Util List::Util Ref::Util
    Time::HiRes JSON JSON::XS Cpanel::JSON::XS Data::Dumper Encode IO::Socket Net::SSLeay Test2
""".split()

# Names that no code calls by itself, and what the checks pass over.
LIFECYCLE = "new import unimport BUILD BUILDARGS DEMOLISH DESTROY AUTOLOAD CLONE meta".split()
CHECKCALLS_SKIP = "new import unimport BUILD BUILDARGS BUILDALL DEMOLISH DESTROY AUTOLOAD CLONE meta does DOES dump tap attr with_roles".split()
DOCCHECK_SKIP = "new import unimport BUILD BUILDARGS DEMOLISH DESTROY AUTOLOAD CLONE meta does DOES".split()
REQUEST_ACCESSORS = "param params cookie cookies upload uploads header headers query_parameters body_parameters route_parameters".split()
CORE_MODULES = """
    strict warnings POSIX Exporter Carp Scalar::Util List::Util
    Digest::SHA Data::Dumper Encode Storable File::Temp File::Spec Cwd Time::HiRes
    Getopt::Long constant overload parent base lib feature utf8 Fcntl Errno
""".split()
